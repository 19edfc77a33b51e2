import pickle
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxtab.llm import quality_classifier as C
from voxtab.llm import toxicity as T
from voxtab.llm.labelled import fold, labelled_sample, trained_in_task


def prose(rng, n):
    return [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200))
        label = i % 4 == 0
        if label:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilewort,", "scumbag", "LOUT!!"]))
        texts.append(" ".join(words).encode())
        labels.append(int(label))
    return texts, np.array(labels)


def test_toxicity_tells_planted_words():
    texts, labels = corpus(1500, 1)
    model = T.train(texts, labels, ["en", "fr", ""] * 500)
    others, truth = corpus(400, 2)
    scores = T.predict(model, others)
    assert ((scores >= 0.3) == truth).mean() > 0.97
    assert set(model.thresholds) >= {"", "en", "fr"}
    long = " ".join(prose(random.Random(3), 30_000)) + " scumbag vilewort"
    empty, late = T.predict(model, [b"", long.encode()])
    assert 0 <= empty < 0.5 < late <= 1
    assert len(T.predict(model, [])) == 0


def test_too_few_labels():
    model = T.train([b"a"], np.array([1]), ["en"])
    assert np.allclose(T.predict(model, [b"x", b""]), 2 / 3)
    fitted = C.train([b"a", b"b"], np.array([1, 1]))
    assert np.allclose(C.predict(fitted, [b"x", b""]), 0.75)
    assert np.allclose(T.predict(T.train([], np.zeros(0, int), []), [b"x"]), 0.5)


def test_thresholds_by_language():
    scores = np.concatenate([np.linspace(0, 0.4, 30), np.linspace(0.6, 1, 30)])
    labels = (scores > 0.5).astype(int)
    found = T.thresholds(scores, labels, ["en"] * 60)
    assert 0.4 < found["en"] < 0.6 and found[""] == found["en"]
    assert T.thresholds(scores[:5], labels[:5], ["en"] * 5) == {"": 0.5}


def test_quality_tells_noise():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(1000):
        words = prose(rng, rng.randint(40, 120))
        texts.append(" ".join(w + "$$$" if i % 5 == 0 and rng.random() < 0.6 else w for w in words).encode())
        labels.append(int(i % 5 != 0))
    fitted = C.train(texts[:800], np.array(labels[:800]))
    scores = C.predict(fitted, texts[800:])
    assert ((scores >= 0.3) == np.array(labels[800:])).mean() > 0.97
    assert 0 <= C.predict(fitted, [b""])[0] <= 1


def test_scores_keep_rows_and_columns(spark):
    texts, labels = corpus(200, 5)
    model, fitted = T.train(texts, labels, ["en"] * 200), C.train(texts, labels)
    rows = [(1, "scumbag vilewort", "a"), (1, "scumbag vilewort", "b"), (None, None, None), (2, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for found in (T.score(df, model), C.score(df, fitted)):
        assert found.columns == ["doc_id", "text", "score"]
        out = found.collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 1}) == 1
        assert found.limit(0).count() == 0
    toxic = T.score(df, model).select(T.is_toxic(model, F.col("score"), F.lit("en")))
    assert toxic.count() == 4


def test_labelled_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(50)] + [(3, "t3", "en"), (None, "x", None)],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (41, None)], "doc_id long, toxic int")
    allowed = fold(F.col("doc_id"), 4) != 2
    found = labelled_sample(docs, labels, "toxic", allowed, 10, 100).collect()
    assert sum(r.label == 0 for r in found) == 10 and sum(r.label == 1 for r in found) == 10
    assert len({r.text for r in found}) == 20
    assert labelled_sample(docs.drop("lang"), labels.limit(0), "toxic", allowed, 10, 100).count() == 0


def test_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    """A rare language and long texts, of which the training sample holds next to nothing."""
    texts, labels = corpus(3000, 6)
    lang = ["xx" if i % 50 < 2 else "en" for i in range(3000)]
    rows = [(i, t.decode(), l) for i, (t, l) in enumerate(zip(texts, lang, strict=True))]
    rows += [(3000 + i, "late words " * 3000 + ("scumbag vilewort" if i % 2 else ""), "yy") for i in range(60)]
    given = [(i, int(v)) for i, v in enumerate(labels)] + [(3000 + i, i % 2) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    known = spark.createDataFrame(given, "doc_id long, toxic int")
    counts = []
    real = T.thresholds_of_counts
    monkeypatch.setattr(T, "thresholds_of_counts", lambda rows: (counts.extend(rows), real(rows))[1])
    model = T.fit(docs, known, F.lit(True), per_class=300)
    assert set(model.thresholds) == {"", "en", "xx", "yy"}
    n_learnt = 600 - 600 // 5
    # All rows that were not learnt from; of long texts slices may have been.
    assert sum(n for *_, n in counts) == 3060 - n_learnt
    assert 60 - 30 < sum(n for lang, _, _, n in counts if lang == "yy") <= 60


def test_thresholds_of_counts():
    rows = [("en", 0, 100, 50), ("en", 1, 900, 50), ("de", 0, 500, 30), ("de", 1, 700, 30), ("fr", 1, 5, 39)]
    found = T.thresholds_of_counts(rows)
    assert set(found) == {"", "de", "en"}
    assert 100 / 1024 < found["en"] <= 900 / 1024 and 500 / 1024 < found["de"] <= 700 / 1024
    assert T.thresholds_of_counts([]) == {"": 0.5}


def test_network_is_a_plain_convolution():
    texts, labels = corpus(200, 4)
    model = T.train(texts, labels, ["en"] * 200)
    some = [*texts[:30], b"", b"one", b"Vilewort, two", b"a b\nc\td"]
    found = T.predict(model, some)
    pads = max(T.WIDTHS)
    for text, score in zip(some, found, strict=True):
        buckets = [*T.word_buckets([w.encode() for w in text.decode().split()]).tolist(), *[[0] * T.TABLES] * pads]
        vectors = [sum(model.embedding[k][b].astype(float) for k, b in enumerate(row)) for row in buckets]
        pooled = []
        for filters, bias in zip(model.filters, model.biases, strict=True):
            for f in range(T.FILTERS):
                answers = [
                    bias[f] + sum(float(vectors[at + o] @ filters[o][:, f]) for o in range(len(filters)))
                    for at in range(len(vectors) - pads + 1)
                ]
                pooled.append(max(0.0, *answers))
        assert np.isclose(score, 1 / (1 + np.exp(-(np.dot(pooled, model.weights) + model.bias))), atol=1e-5)


def test_descent_finds_the_least_hinge_loss():
    """Against plain subgradient steps on the primal, and the conditions of the optimum."""
    rng = np.random.default_rng(5)
    labels = np.array([0, 1] * 20)
    rows = [np.unique(rng.integers(0, 12, 5) + 6 * y) for y in labels]
    ratio = C.ratios(rows, labels)
    weights, bias = C.descend(rows, labels, ratio, 400, 4.0, 7)
    values = [ratio[r] / np.sqrt((ratio[r] ** 2).sum()) for r in rows]
    sign = np.where(labels == 1, 1, -1)

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values, strict=True)])
        return (w @ w + b * b) / 2 + (4.0 / (2 * 0.5) * np.maximum(0, 1 - sign * margins)).sum()

    w, b, least = np.zeros(24), 0.0, np.inf
    for step in range(1, 6001):
        slope, lean = w.copy(), b
        for r, v, s in zip(rows, values, sign, strict=True):
            if s * (w[r] @ v + b) < 1:
                slope[r] -= 4.0 * s * v
                lean -= 4.0 * s
        w, b = w - slope / step, b - lean / step
        least = min(least, loss(w, b))
    assert loss(weights[:24], bias) <= least * 1.001 and not weights[24:].any()


def test_slices_of_long_texts_are_learnt_from(spark):
    rows = [(i, " ".join(f"{c}{k}" for k in range(40)), "en") for i, c in enumerate("abcdef")] + [(3, "other text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(6)], "doc_id long, toxic int")
    found = {r.doc_id: r.text for r in labelled_sample(docs, labels, "toxic", F.lit(True), 10, 50).collect()}
    assert set(found) == set(range(6))
    texts = dict(enumerate(t for _, t, _ in rows[:6]))
    assert all(len(t) == 50 and t in texts[i] for i, t in found.items() if i != 3)
    assert found == {r.doc_id: r.text for r in labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 10, 50).collect()}


def test_quality_curve_comes_from_all_labelled_rows(spark, monkeypatch):
    texts, labels = corpus(600, 6)
    texts[0] = b"w1 " * 30_000
    docs = spark.createDataFrame([(i, t.decode(), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int")
    seen, real = [], C.calibrated

    def counted(found, labels, counts=None, **more):
        seen.append(None if counts is None else counts.sum())
        return real(found, labels, counts, **more)

    monkeypatch.setattr(C, "calibrated", counted)
    fitted = C.fit(docs, known, F.lit(True), per_class=60)
    assert seen[-1] == 600 - 120 + 24
    scores = {r.doc_id: r.score for r in C.score(docs, fitted).collect()}
    assert np.mean([(scores[i] >= 0.3) == y for i, y in enumerate(labels)]) > 0.9


def test_languages_without_labels_of_their_own(spark):
    texts, labels = corpus(400, 8)
    lang = lambda i: f"rare{i}" if i % 10 == 0 else "en"
    docs = spark.createDataFrame([(i, t.decode(), lang(i)) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    model = T.fit(docs, known, F.lit(True), per_class=100)
    assert set(model.thresholds) == {"", "en"}
    row = spark.range(1).select(*(T.threshold_of(model, F.lit(x)).alias(x) for x in ("en", "rare0"))).first()
    assert (row.en, row.rare0) == (model.thresholds["en"], model.thresholds[""])


def test_models_reach_the_driver_in_small_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some text", "en") for i in range(60)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = labelled_sample(docs, known, "toxic", F.lit(True), 30, 100)
    seen, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (seen.extend(rows := real(df)), rows)[1])
    table = np.arange(400_000)
    made, ids, labels = trained_in_task(sample, lambda texts, labels, langs: (table, len(texts), langs))
    assert np.array_equal(made[0], table) and made[1:] == (60, ["en"] * 60)
    assert sorted(ids) == list(range(60)) and [i % 2 for i in ids] == labels.tolist()
    assert len(seen) > 1 and max(len(r.made) for r in seen) <= 1 << 18


def test_a_model_is_sent_once(spark, monkeypatch):
    texts, labels = corpus(300, 9)
    docs = spark.createDataFrame([(i, t.decode(), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    seen, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: (seen.append(value), real(context, value))[1])
    model = T.fit(docs, known, F.lit(True), per_class=100)
    scores = T.score(docs, model).collect()
    large = [v for v in seen if len(pickle.dumps(v)) > model.embedding.nbytes]
    assert len(large) == 1
    assert np.allclose([r.score for r in sorted(scores)], T.predict(model, texts))


def test_texts_are_scored_some_at_a_time(spark, monkeypatch):
    """Rows come in batches of many MB, of which a worker makes tables for a part at a time."""
    model = T.constant(0.5)
    table = pa.table({"doc_id": range(60), "text": [None, *(f"word{i} " * 10_000 for i in range(59))]})
    monkeypatch.setattr(T, "predict", lambda model, texts: np.array([sum(map(len, texts))] * len(texts), float))
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: made.append(run))
    T.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model)
    found = pa.Table.from_batches(made[0](iter(table.to_batches())))
    sizes = found["score"].to_numpy()
    assert len(sizes) == 60 and found["doc_id"].to_pylist() == list(range(60))
    assert 1 << 20 <= sizes.max() < (1 << 20) + 100_000
