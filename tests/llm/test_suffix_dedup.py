import random

import numpy as np
import pyarrow as pa

from voxtab.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                w = data[i : i + 50]
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if doc is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < doc:
                    gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append(str((doc, len(data), [tuple(e) for e in edges.tolist()], kept)))
    return sorted(out)


def found(df):
    return sorted(
        str((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)))
        for r in S.deduplicate(df).collect()
    )


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (9, 10, 12, 14, 40, 80)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "\0" * 120, "\0" * 60 + "ab", "y" * 30]
    for _ in range(60):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 12)
            parts += [p[cut:] if rng.random() < 0.5 else p, prose(rng.randint(0, 10))]
        texts.append("".join(parts) if rng.random() < 0.5 else " ".join(parts))
    texts += [texts[20], texts[21][3:], texts[22] + texts[23], "ab" * 100, "ba" * 100]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[20]), (30, texts[30]), (30, texts[31])]


def test_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == brute(rows)


def test_frequent_lines_like_brute_force(spark):
    rng = random.Random(8)
    line = "this line of more than fifty bytes stands in every document of them all"
    rows = [(i, f"{rng.random()} {rng.random()}\n{line}\n{rng.random()}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert S.frequent_digits(df).any()
    assert found(df) == brute(rows)


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 60, "x", 3), (2, "a" * 70, None, 4)], "doc_id long, text string, kept string, whole int")
    out = S.deduplicate(df)
    assert out.columns == ["doc_id", "whole", "removed", "kept", "n_bytes"]
    assert {r.doc_id: (r.whole, bytes(r.kept)) for r in out.collect()} == {1: (3, b"a" * 60), 2: (4, b"")}
    assert S.deduplicate(df.limit(0)).count() == 0


def test_anchors_in_every_window():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 10, 49, 50, 51, 200]))) for _ in range(60)] + [b"a" * 300]
    a = S.Anchors(texts)
    for i, text in enumerate(texts):
        own = set((a.places[a.owner == i] - a.begin[i]).tolist())
        assert all(any(s <= p <= s + S.REACH for p in own) for s in range(len(text) - 49))


class Batches:
    """Stands for a table, to run a stage on its batches here."""

    def __init__(self, rows):
        ids, texts = zip(*rows, strict=True)
        self.rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.rows])))


def packs_of(rows, buckets):
    made = S.suffixes(Batches(rows), np.zeros(S.TABLE, np.uint8), buckets)
    table = pa.Table.from_batches(made).sort_by("bucket")
    return table.to_batches()


def random_text(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def test_packs_hold_suffixes_of_several_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1 << 16)
    rng, buckets = random.Random(11), 200
    rows = [(i, random_text(rng, 2000)) for i in range(600)]
    packs = [p for b in packs_of(rows, buckets) for p in b.column(1).to_pylist()]
    assert len(packs) <= buckets
    keys, arounds, sides, docs = (np.concatenate(c) for c in zip(*map(S.unpacked_rows, packs), strict=True))
    found = S.Anchors([t.encode() for _, t in rows])
    assert sorted(zip(docs.tolist(), arounds.tolist(), sides.tolist(), strict=True)) == sorted(
        zip(found.owner.tolist(), found.around.tolist(), found.sides(np.arange(len(found.owner))).tolist(), strict=True)
    )
    assert sorted(keys.tolist()) == sorted(S.range_key(found.digit).tolist())
    assert sum(map(len, packs)) < 14 * len(keys)


def test_anchors_that_share_no_window_stay_closed():
    rng = random.Random(12)
    phrases = [random_text(rng, 30) for _ in range(100)]
    rows = [(i, random_text(rng, 60) + phrases[i % 100] + random_text(rng, 60)) for i in range(200)]
    packs = packs_of(rows, 4)
    keys, docs = (np.concatenate(c) for c in zip(*((k, d) for b in packs for p in b.column(1).to_pylist()
                                                   for k, _, _, d in [S.unpacked_rows(p)]), strict=True))
    assert len(keys) - len(np.unique(keys)) > 50
    marks = sum(b.num_rows for b in S.sorted_groups(iter(packs)))
    assert marks < 10


def test_shared_runs_of_each_length_at_each_place(spark):
    rng = random.Random(13)
    rows = []
    for n in range(46, 90, 2):
        run = random_text(rng, n)
        for before, behind in ((0, 0), (0, 40), (40, 0), (7, 9), (18, 16), (60, 60)):
            rows.append((len(rows), random_text(rng, before) + run + random_text(rng, behind)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == brute(rows)
