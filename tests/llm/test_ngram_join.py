import random

import numpy as np

from voxtab.llm import ngram_join as N
from voxtab.llm.components import components
from voxtab.llm.shingles import shingle_sets


def brute(rows):
    sets = []
    for _, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        n = len(words)
        sets.append({tuple(words[i : i + 5]) for i in range(n - 4)} if n >= 5 else ({tuple(words)} if n else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return sorted(
        str((doc, len(sets[i]), lowest.get(find(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows)
    )


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(40)
    texts = [None, "", " \n ", "one", "One", "one two three four", "a b c d e", "A b\tc d\ne"]
    for _ in range(12):
        base = make(rng.choice([6, 9, 14, 30, 120]))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(make(30) + passage + make(20)) for _ in range(40)]
    big = make(150)
    for _ in range(80):
        copy = list(big)
        for _ in range(4):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 10 + ["only " * 3000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[30]), (7, texts[7]), (None, "nobody else has this text at all")]


def test_components_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = N.near_duplicates(df).collect()
    assert sorted(str(tuple(r)) for r in found) == brute(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, n int, root long")
    assert [tuple(r) for r in N.near_duplicates(df).collect()] == [(1, 1, 1)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_first_elements_meet():
    """Like sets share an element, and small ones a pair, among their first elements."""
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 4, N.TABLE).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 40, n))
        b = a[rng.random(len(a)) > 0.12]
        extra = rng.integers(0, 1 << 40, int(rng.integers(0, n // 8 + 1)))
        b = np.unique(np.concatenate([b, extra]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 75 * (len(a) + len(b) - common):
            assert np.intersect1d(N.first_elements(a, levels, 0), N.first_elements(b, levels, 0)).size >= 1
            if min(len(a), len(b)) > 1 and common > 1:
                assert np.intersect1d(N.first_elements(a, levels, 1), N.first_elements(b, levels, 1)).size >= 2


def test_boundary_by_cost():
    assert N.choose_boundary([]) == 0
    assert N.choose_boundary([(4, 100, 1e6)]) >= 4
    assert N.choose_boundary([(60, 100, 100.0)]) == 0


def test_sketches_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 40, 300))
        b = np.unique(np.concatenate([a[: rng.integers(200, 300)], rng.integers(0, 1 << 40, 20)]))
        apart = len(np.setxor1d(a, b))
        bits = np.frombuffer(N.sketch_of(a), np.uint8) ^ np.frombuffer(N.sketch_of(b), np.uint8)
        assert np.bitwise_count(bits).sum() <= apart
        assert (N.unpack_elements(N.pack_elements(a.astype(np.uint64) << np.uint64(24))) == a).all()


def test_shingles():
    sets = shingle_sets([b"a b c d e f", b"A B\x0bC D E F", b"a b c d e a b c d e", b"a", b"", "é É".encode()])
    assert (sets[0] == sets[1]).all()
    assert [len(s) for s in sets] == [2, 2, 5, 1, 0, 1]


def test_components_of_a_path(spark):
    rng = random.Random(2)
    names = list(range(1000, 1060))
    rng.shuffle(names)
    edges = list(zip(names, names[1:])) + [(5, 6), (6, 6), (5, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(map(tuple, components(df).collect()))
    assert {n: found.get(n, n) for n in names} == dict.fromkeys(names, 1000)
    assert found[6] == 5
    assert components(df.limit(0)).count() == 0


def test_many_small_texts_of_common_lines(spark):
    """Short texts made of the same few lines: many share pairs of elements, few are alike."""
    rng = random.Random(12)
    lines = [" ".join(f"l{i}x{j}" for j in range(rng.randint(6, 12))) for i in range(9)]
    texts = [" ".join(rng.sample(lines, rng.randint(1, 4))) for _ in range(250)]
    texts += [" ".join([*rng.sample(lines, 3), f"end{i}"]) for i in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in N.near_duplicates(df).collect()) == brute(rows)


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """Frequent passages in texts that are not alike, and a large family beside them."""
    seen = []
    real = N.in_blocks

    def counted(rows, heavy):
        seen.append((heavy.where("parts > 1").count(), real(rows, heavy).groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0]))
        return real(rows, heavy)

    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "in_blocks", counted)
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(12)]
    rows = [(i, " ".join(rng.sample(passages, 4))) for i in range(150)] + corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(str(tuple(r)) for r in N.near_duplicates(df).collect())
    assert found == brute(rows)
    assert seen[0][0] > 0 and seen[0][1] <= 8 * 8


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """Whatever the number of shuffle partitions, and the same roots from one task and from many."""
    from voxtab.llm import components as module

    edges = spark.range(400).selectExpr("id a", "case when id % 20 = 0 then id else id - 1 end b")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for least, tasks in ((module.EDGES_OF_TASK, 1), (50, 8)):
            monkeypatch.setattr(module, "EDGES_OF_TASK", least)
            found = components(edges)
            assert found.rdd.getNumPartitions() <= tasks
            assert dict(map(tuple, found.collect())) == {k: k - k % 20 for k in range(400) if k % 20}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_are_sent_once(spark, monkeypatch):
    """Tables that several functions use do not travel within each of them."""
    rows = [(i, " ".join(f"w{(i // 2) * 40 + k}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(40)]
    seen, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: (seen.append(value), real(context, value))[1])
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(40)}
    assert sum(isinstance(v, bytes) and len(v) > N.TABLE for v in seen) <= 1
