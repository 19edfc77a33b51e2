"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Filters of several widths slide over the words of a whole text, the strongest answer of each
is kept, and a logistic layer weighs these answers.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtab.llm.common import cut, in_chunks, split_words, text_chunks, tidied
from voxtab.llm.labelled import known_labels, labelled_sample, shared_by, trained_in_task
from voxtab.llm.ngram_join import among, marked

# Sizes of the model: tables of hashed words and their buckets, numbers a word, widths of
# filters, filters a width.
TABLES = 3
BUCKETS = 1 << 16
# Bytes of a word's beginning, by which the last table tells words.
STEM = 5
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
# Bounds of the training sample: rows of each class, characters of a text.
PER_CLASS = 3000
LONGEST = 20_000
EPOCHS = 6
# Bytes of text that are scored together, with about 30 bytes of tables a byte.
SCORED_BYTES = 1 << 20
# Rows of a class, below which nothing is learnt; rows of a language, from which it has a
# threshold of its own.
LEAST_ROWS, LEAST_OF_LANGUAGE = 10, 40
# Steps of thresholds: a power of two, so that the edges of bins are exact.
BINS = 1024
# What a row of label 0 counts against one of label 1: false alarms cost more.
CLEAN_WEIGHT = 3.0


class Model(NamedTuple):
    """A word's embedding is the sum of its rows in all tables: two by hashes of the word, so
    that words which share a bucket of one differ, the last by its beginning. thresholds: by language; "" holds for all others.
    shared: what executors have of it."""

    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]
    shared: Broadcast | None = None


class Sequences(NamedTuple):
    """words: places in `buckets`, each text followed by padding that lets every filter answer;
    starts: where each text begins, and the end; buckets: a row a word, a column a table."""

    words: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Of words in lower case (A-Z) without marks at their ends. Bucket 0 is for padding."""
    marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    columns = np.empty((len(words), TABLES), np.int64)
    for start in range(0, len(words), 1 << 15):
        plain = [w.lower().strip(marks) for w in words[start : start + (1 << 15)]]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain))
        stems = (xxhash.xxh3_64_intdigest(w[:STEM]) for w in plain)
        stems = np.fromiter(stems, np.uint64, len(plain))
        rows = np.stack([hashes, hashes >> np.uint64(24), stems], axis=1)
        columns[start : start + len(plain)] = rows % np.uint64(BUCKETS - 1) + np.uint64(1)
    return columns


def sequences(texts: list[bytes]) -> Sequences:
    codes, unique, bounds = split_words(texts)
    width, pad = max(WIDTHS), len(unique)
    sizes = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(sizes + width)])
    words = np.full(starts[-1], pad, np.int64)
    words[np.arange(len(codes)) + np.repeat(width * np.arange(len(texts)), sizes)] = codes
    buckets = np.zeros((pad + 1, TABLES), np.int64)
    if unique:
        buckets[:pad] = word_buckets(unique)
    return Sequences(words, starts, buckets)


def keyed_texts(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text, padding included, as one number each that holds its buckets."""
    found = []
    for a, b in in_chunks(texts):
        words, starts, buckets = sequences(texts[a:b])
        keys = sum(buckets[:, k] << (16 * k) for k in range(TABLES))[words]
        found += [keys[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
    return found


def buckets_of(keys: np.ndarray) -> np.ndarray:
    return np.stack([(keys >> (16 * k)) & 0xFFFF for k in range(TABLES)], axis=1)


def answers(vectors: np.ndarray, filters, biases, words: np.ndarray, starts: np.ndarray):
    """Per width: the answer of each filter at each word, and the best in each text. vectors: of
    the words that `words` points to. Windows do not cross the padding between texts."""
    width = max(WIDTHS)
    last = len(words) - width + 1
    cut = np.zeros(last, bool)
    for end in range(1, width):
        over = starts[1:] - end
        cut[over[over < last]] = True
    for parts, bias in zip(filters, biases, strict=True):
        found = np.repeat(bias[None, :], last, axis=0)
        for offset, part in enumerate(parts):
            found += (vectors @ part)[words[offset : offset + last]]
        found[cut] = -np.inf
        yield found, np.maximum.reduceat(found, starts[:-1], axis=0)


def vectors_of(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return sum(embedding[k][buckets[:, k]] for k in range(TABLES))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict(model: Model, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    words, starts, buckets = sequences(texts)
    vectors = vectors_of(model.embedding, buckets)
    best = [b for _, b in answers(vectors, model.filters, model.biases, words, starts)]
    return sigmoid(np.maximum(np.concatenate(best, axis=1), 0) @ model.weights + model.bias)


def log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket of each table: how much more often texts of label 1 hold it, smoothed."""
    totals = np.bincount(labels, minlength=2)[:, None] + 1
    counts = np.zeros((2, TABLES, BUCKETS))
    for text, label in zip(texts, labels, strict=True):
        for k, column in enumerate(buckets_of(text).T):
            counts[label, k, np.unique(column)] += 1
    rates = (counts + 3) / (totals[:, :, None] + 6)
    return np.log(rates[1] / rates[0])


def constant(share: float) -> Model:
    """A model that scores every text alike."""
    return Model(
        np.zeros((TABLES, BUCKETS, DIM), np.float32),
        tuple(np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS),
        tuple(np.zeros(FILTERS, np.float32) for _ in WIDTHS),
        np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log(share / (1 - share))), {"": 0.5},
    )


class Adagrad:
    """Steps of single parameters, smaller the more they have moved."""

    def __init__(self, rate: float = 0.05):
        self.rate, self.squares = rate, {}

    def step(self, p: np.ndarray, slope: np.ndarray, place=...) -> None:
        s = self.squares.setdefault(id(p), np.full_like(p, 1e-4))
        s[place] += slope**2
        p[place] -= self.rate * slope / np.sqrt(s[place])


def too_few(labels: np.ndarray) -> bool:
    return len(labels) == 0 or min(np.bincount(labels, minlength=2)) < LEAST_ROWS


def kept_from_fit(n: int) -> np.ndarray:
    """Which of the n rows of a training sample are not learnt from."""
    return np.arange(n) % 5 == 4


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits all parts of the model by Adagrad on four of five rows; the fifth sets thresholds.

    The first number of each bucket starts from its log odds, the others at random. Fewer than
    ten rows of either label: a model that scores the share of label 1 everywhere."""
    rng = np.random.default_rng(seed)
    n_all = len(labels)
    if too_few(labels):
        return constant((labels.sum() + 1) / (n_all + 2) if n_all else 0.5)
    own = keyed_texts(texts)
    held = kept_from_fit(n_all)
    rows = np.flatnonzero(~held)
    embedding = rng.normal(0, 0.05, (TABLES, BUCKETS, DIM)).astype(np.float32)
    odds = log_odds([own[i] for i in rows], labels[rows])
    embedding[:, :, 0] = np.clip(odds, -3, 6) / 3
    embedding[:, 0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :] = np.abs(f[0, 0, :]) + 0.3
    biases = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
    weights = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    bias = np.full(1, -1, np.float32)
    cost = np.where(labels == 1, 1.0, CLEAN_WEIGHT)
    learn = Adagrad()
    tables = list(embedding)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            at = np.concatenate([[0], np.cumsum([len(own[i]) for i in chosen])])
            seen, batch = np.unique(np.concatenate([own[i] for i in chosen]), return_inverse=True)
            buckets = buckets_of(seen)
            vectors = vectors_of(embedding, buckets)
            found = list(answers(vectors, filters, biases, batch, at))
            pooled = np.concatenate([b for _, b in found], axis=1)
            active = np.maximum(pooled, 0)
            error = sigmoid(active @ weights + bias[0]) - labels[chosen]
            error = (error * cost[chosen] / len(chosen)).astype(np.float32)
            back = error[:, None] * weights * (pooled > 0)
            learn.step(weights, active.T @ error + 1e-4 * weights)
            learn.step(bias, np.array([error.sum()], np.float32))
            change = np.zeros_like(vectors)
            for k, width in enumerate(WIDTHS):
                answer = found[k][0]
                best = np.array([
                    answer[a : min(b, len(answer))].argmax(axis=0) + a
                    for a, b in zip(at[:-1], at[1:], strict=True)
                ])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                slope = np.zeros_like(filters[k])
                for offset in range(width):
                    near = batch[best + offset]
                    slope[offset] = np.einsum("nf,nfd->df", part, vectors[near])
                    pull = part[:, :, None] * filters[k][offset].T[None]
                    np.add.at(change, near.ravel(), pull.reshape(-1, DIM))
                learn.step(filters[k], slope)
                learn.step(biases[k], part.sum(axis=0))
            moved = np.flatnonzero(np.any(change, axis=1) & (buckets[:, 0] > 0))
            for k in range(TABLES):
                places, which = np.unique(buckets[moved, k], return_inverse=True)
                slopes = np.zeros((len(places), DIM), np.float32)
                np.add.at(slopes, which, change[moved])
                learn.step(tables[k], slopes, places)
    model = Model(embedding, tuple(filters), tuple(biases), weights, float(bias[0]), {})
    mine = np.flatnonzero(held)
    tested = [texts[i] for i in mine]
    parts = [predict(model, tested[a:b]) for a, b in in_chunks(tested, SCORED_BYTES)]
    scores = np.concatenate([np.zeros(0), *parts])
    return model._replace(thresholds=thresholds(scores, labels[held], [langs[i] for i in mine]))


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = LEAST_OF_LANGUAGE) -> dict[str, float]:
    """By language, the score at which most rows are told right, in the middle of the gap;
    languages with fewer than `least` rows, or of one label only, use that of all rows."""
    found = {}
    tongues = np.array(langs, object)
    for lang in ["", *sorted(set(langs) - {""})]:
        mine = np.ones(len(labels), bool) if lang == "" else tongues == lang
        s, y = scores[mine], labels[mine]
        if lang == "" and (len(y) == 0 or y.min() == y.max()):
            found[""] = 0.5
        elif lang == "" or len(y) >= least and y.min() != y.max():
            order = np.argsort(s, kind="stable")
            cuts = np.concatenate([[0.0], (s[order][1:] + s[order][:-1]) / 2, [1.0]])
            below = np.concatenate([[0], np.cumsum(y[order])])
            right = y.sum() - below + np.arange(len(y) + 1) - below
            good = cuts[right == right.max()]
            found[lang] = float(np.clip(np.median(good), 0.05, 0.95))
    return found


def binned_counts(docs: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """lang, label, bin, n: how many labelled documents have each score, over whole texts of any
    length. known: doc_id, label. Rows that repeat id, language and score count once.

    Only ids, languages and scores are shuffled."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    wanted = marked(known.select(F.xxhash64("doc_id").alias("id")))
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.xxhash64("doc_id").alias("__key"), "doc_id", F.coalesce(lang, F.lit("")).alias("lang"), "text"
    )
    scored = score(among(rows, wanted, True), model).select("doc_id", "lang", "score")
    step = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    found = scored.join(known, "doc_id").distinct()
    return found.groupBy("lang", "label", step.alias("bin")).agg(F.count("*").alias("n"))


def thresholds_of_counts(rows: list[tuple[str, int, int, int]], least: int = LEAST_OF_LANGUAGE) -> dict[str, float]:
    """As `thresholds`, from rows (lang, label, bin, n) and at edges of bins."""
    tables: dict[str, np.ndarray] = {"": np.zeros((2, BINS), np.int64)}
    for lang, label, place, n in rows:
        for name in {"", lang}:
            tables.setdefault(name, np.zeros((2, BINS), np.int64))[label, place] += n
    edges = np.arange(BINS + 1)
    able = (edges >= 0.05 * BINS) & (edges <= 0.95 * BINS)
    found = {"": 0.5}
    for lang, (clean, toxic) in sorted(tables.items()):
        if clean.sum() and toxic.sum() and (lang == "" or clean.sum() + toxic.sum() >= least):
            right = np.append(0, clean.cumsum()) + toxic.sum() - np.append(0, toxic.cumsum())
            good = edges[able & (right == right[able].max())]
            found[lang] = float(good[len(good) // 2] / BINS)
    return found


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> Model:
    """Trains on at most `per_class` labelled rows of each label, in one task; thresholds come
    from all labelled rows but those learnt from."""
    sample = labelled_sample(docs, labels, "toxic", allowed, per_class, LONGEST)
    made, ids, sampled = trained_in_task(sample, train)
    model = shared_by(Model(*made), docs)
    if too_few(sampled):
        return model
    # At most 2 * per_class ids: small by construction.
    learnt = [(i,) for i, kept in zip(ids, kept_from_fit(len(ids)), strict=True) if not kept]
    learnt = docs.sparkSession.createDataFrame(learnt, sample.select("doc_id").schema)
    learnt = F.broadcast(learnt)
    known = known_labels(labels, "toxic", allowed).join(learnt, "doc_id", "left_anti")
    counts = cut(binned_counts(docs, known, model))
    # Languages with few labelled rows have no threshold of their own, and there may be many of
    # them: they count together. A row for each language, label and bin reaches the driver.
    large = counts.groupBy("lang").agg(F.sum("n").alias("rows")).where(F.col("rows") >= LEAST_OF_LANGUAGE)
    own = F.when(F.col("rows").isNotNull(), F.col("lang")).otherwise("")
    counts = counts.join(large, "lang", "left").groupBy(own.alias("lang"), "label", "bin").agg(F.sum("n").alias("n"))
    counts = counts.collect()
    return model._replace(thresholds=thresholds_of_counts([tuple(r) for r in counts]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with `score`: 0 to 1, higher for toxic. Whole texts count; a null or empty
    one is scored as padding alone. Repeated rows score alike; a column of the input named
    score gives way. Every row is scored where it is read."""
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    place = kept.columns.index(text)
    held = model.shared or shared_by(model, docs).shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [predict(held.value, texts) for _, texts in text_chunks(batch.column(place), SCORED_BYTES)]
            scores = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"]
            )

    return kept.mapInArrow(tidied(run), schema)


def threshold_of(model: Model, lang: Column) -> Column:
    own = [F.lit(v) for item in sorted(model.thresholds.items()) if item[0] for v in item]
    common = F.lit(model.thresholds[""])
    return F.coalesce(F.try_element_at(F.create_map(*own), lang), common) if own else common


def is_toxic(model: Model, score: Column, lang: Column) -> Column:
    """Whether a score reaches its language's threshold."""
    return score >= threshold_of(model, lang)
