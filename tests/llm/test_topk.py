import random

import pyarrow as pa
from pyspark.sql import functions as F

from voxtab.llm import topk as T


def brute(rows, queries, k):
    out = []
    for q, w in queries:
        scored = [
            (-sum(a * b for a, b in zip(w, v)), i is None, i or 0)
            for i, v in rows if v is not None and i != q
        ]
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-3, 3) for _ in range(rng.choice([0, 2, 8]))]) for i in range(400)]
    rows += [(7, rows[7][1]), (None, [1, 1]), (None, None), (500, None)] + [(600 + i, [1] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, w array<long>").repartition(3)
    queries = [(i, w) for i, w in rows if i is not None and i % 50 == 0 and w is not None]
    found = T.top_k(df, df.where("vec_id % 50 = 0"), 10, shards=3).collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows, queries, 10)


def test_few_rows_and_repeats(spark):
    df = spark.createDataFrame([(0, [2]), (0, [1]), (1, [5])], "vec_id long, w array<long>")
    found = T.top_k(df, df.where("vec_id = 0"), 10, shards=1).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 5)]
    assert T.top_k(df.limit(0), df, 3, shards=2).count() == 0
    assert T.top_k(df, df.limit(0), 3, shards=2).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.0001],), ([float("nan")],), ([None, 1.0],), ([float("-inf")],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(T.quantised(F.col("v"))).collect()] == [[512, -1], None, None, None, None, []]


def test_weights_of_every_size_and_many_ties(spark):
    rng = random.Random(5)
    for most in (1, 9, 1000, 1 << 20, 1 << 30):
        rows = [(i % 290 if i % 7 else None, [rng.randint(-most, most) for _ in range(rng.choice([1, 3]))]) for i in range(300)]
        rows += [(1000 - i, [most, most, 0]) for i in range(150)]
        df = spark.createDataFrame(rows, "vec_id long, w array<long>").repartition(2)
        ids = {}
        for i, w in rows:
            if i is not None and i % 50 == 0:
                ids[i] = min(w, ids.get(i, w))
        for shards in (1, 210):
            found = T.top_k(df, df.where("vec_id % 50 = 0"), 4, shards=shards).collect()
            assert sorted([tuple(r) for r in found], key=str) == brute(rows, ids.items(), 4)


def pack(rows):
    ids, weights = zip(*rows, strict=True)
    return T.packed(pa.array(ids, pa.int64()), pa.array(weights, pa.list_(pa.int64())))


def test_cells_keep_the_best_of_all_their_blocks():
    rng = random.Random(6)
    rows = [(i, [rng.randint(-900, 900) for _ in range(6)]) for i in range(3000)]
    asked = rows[::100]
    cells = [(0, False, pack(rows[a : a + 600])) for a in range(0, 3000, 600)] + [(0, True, pack(asked))]
    columns = [pa.array(c) for c in zip(*cells, strict=True)]
    found = list(T.search(iter([pa.RecordBatch.from_arrays(columns, names=["cell", "asks", "pack"])]), 10))
    assert sum(b.num_rows for b in found) == 10 * len(asked)
    got = [(q, v, s) for b in found for q, v, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((q, v, s) for q, _, v, s in brute(rows, asked, 10))


def test_packs_take_the_bytes_that_weights_need():
    rows = [(i, [1023, -1024] * 32) for i in range(100)]
    assert len(pack(rows)) < 100 * (64 * 2 + 16)
    block = T.Block(pack([(3, [1 << 40]), (None, [2, 3]), (1, [])]))
    assert block.ids[:2].tolist() == [1, 3] and block.n_known == 2
    assert block.weights.tolist() == [[0, 0], [1 << 40, 0], [2, 3]]
