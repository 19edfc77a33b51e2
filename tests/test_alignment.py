import json
import random

import pytest
from pyspark.sql import functions as F

from voxtab.operators import alignment as AL
from voxtab.sources.alignment import parse_alignment, read_alignment

SEG = "guid string, seg_index int, seg_start double, seg_end double, text string"
WORD = "guid string, word_index int, word_start double, word_end double, word string"
TIMING = "array<struct<start: double, end: double, text: string>>"


def matches(seg, words):
    g, _, start, end, _ = seg
    return [w for w in words if w[0] == g and w[2] is not None and start <= w[2] <= end]


def check(spark, segs, words):
    sdf = spark.createDataFrame(segs, SEG)
    wdf = spark.createDataFrame(words, WORD)
    got = {
        (r.guid, r.seg_index): (r.refined_start, r.refined_end)
        for r in AL.refine_segments(sdf, wdf).collect()
    }
    pairs = {}
    for r in AL.align_words(sdf, wdf).collect():
        pairs.setdefault((r.guid, r.seg_index), []).append(r.word_index)
    assert len(got) == len(segs)
    for seg in segs:
        key = seg[:2]
        hits = sorted(matches(seg, words), key=lambda w: w[1])
        want = (hits[0][2], hits[-1][3]) if hits else (seg[2], seg[3])
        assert got[key] == want, seg
        assert sorted(pairs[key], key=lambda k: k or 0) == ([w[1] for w in hits] or [None]), seg


def test_inclusive_bounds_and_file_order(spark):
    segs = [("g", 0, 0.0, 2.0, "a"), ("g", 1, 2.0, 4.0, "b"), ("g", 2, 9.0, 9.5, "c"), ("h", 0, 0.0, 9.0, "d")]
    words = [
        ("g", 1, 0.5, 0.9, "w"), ("g", 2, 2.0, 2.4, "w"), ("g", 3, 1.0, 9.9, "w"), ("g", 4, 4.0, 4.1, "w"),
        ("g", 5, 3.0, None, "w"),
    ]
    check(spark, segs, words)


def test_nan_is_no_bound(spark):
    nan = float("nan")
    segs = [("g", 0, 0.0, nan, "a"), ("g", 1, nan, 2.0, "b"), ("g", 2, nan, nan, "c"), ("g", 3, 0.0, 9.0, "d")]
    words = [("g", 1, 1.0, 2.0, "w"), ("g", 2, nan, 3.0, "w"), ("g", 3, 4.0, nan, "w"), ("g", 4, 10.0, 11.0, "w")]
    got = {r.seg_index: r for r in AL.refine_segments(spark.createDataFrame(segs, SEG), spark.createDataFrame(words, WORD)).collect()}
    assert [str(got[k].refined_start) for k in range(4)] == ["0.0", "nan", "nan", "1.0"]
    assert [str(got[k].refined_end) for k in range(4)] == ["nan", "2.0", "nan", "nan"]
    pairs = AL.align_words(spark.createDataFrame(segs, SEG), spark.createDataFrame(words, WORD)).collect()
    assert sorted((r.seg_index, r.word_index or 0) for r in pairs) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 3)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 40.0, 3000.0])
def test_random_intervals(spark, scale):
    rng = random.Random(int(scale * 100))
    grid = lambda hi: round(rng.uniform(-2, hi) * 4) / 4 * scale
    segs = []
    for k in range(150):
        start = grid(100)
        segs.append((f"g{k % 3}", k, start, start + abs(grid(rng.choice([1, 10, 120]))), "t"))
    words = []
    for k in range(500):
        start = None if k % 97 == 0 else grid(220)
        words.append((f"g{rng.randint(0, 3)}", k, start, None if start is None else start + scale, "w"))
    check(spark, segs, words)


def test_stray_bounds(spark):
    inf = float("inf")
    segs = [
        ("g", 0, -1e300, 1e300, "all"), ("g", 1, 5.0, 1e15, "long"), ("g", 2, 9.0, 3.0, "backwards"),
        ("g", 3, 1e12, 1e13, "far"), ("g", 4, -inf, inf, "inf"), ("g", 5, 0.0, 5e8, "years"),
    ]
    words = [("g", 1, 7.0, 7.5, "w"), ("g", 2, 2e12, 2e12, "w"), ("g", 3, -1e14, 0.0, "w"), ("g", 4, 6.0, 6.5, "w")]
    check(spark, segs, words)


def test_one_recording_with_everything(spark):
    """Long overlapping segments of one recording: rows read stay near linear."""
    n = 1500
    segs = spark.range(n).select(
        F.lit("hot").alias("guid"), F.col("id").cast("int").alias("seg_index"),
        (F.col("id") * 0.5).alias("seg_start"), (F.col("id") * 0.5 + 3000).alias("seg_end"), F.lit("t").alias("text"),
    )
    words = spark.range(8000).select(
        F.lit("hot").alias("guid"), F.col("id").cast("int").alias("word_index"),
        (F.col("id") * 0.45).alias("word_start"), (F.col("id") * 0.45 + 0.3).alias("word_end"), F.lit("w").alias("word"),
    )
    got = {r.seg_index: r for r in AL.refine_segments(segs, words).collect()}
    for k in (0, 7, n - 1):
        first = next(j for j in range(8000) if j * 0.45 >= k * 0.5)
        last = max(j for j in range(8000) if j * 0.45 <= k * 0.5 + 3000)
        assert got[k].refined_start == first * 0.45
        assert got[k].refined_end == pytest.approx(last * 0.45 + 0.3)
    reads = F.size(AL._cover(F.lit(0).cast("bigint"), F.lit(10**5).cast("bigint")))
    assert spark.range(1).select(reads).collect()[0][0] < 300


def test_cover_tiles_exactly(spark):
    rng = random.Random(9)
    spans = [(a, a + rng.choice([0, 1, 62, 63, 64, 65, 500, 70000])) for a in range(-300, 300, 7)]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint")
    for r in df.select("lo", "hi", AL._cover(F.col("lo"), F.col("hi")).alias("codes")).collect():
        covered = []
        for code in r.codes:
            level, cell = code % AL.LEVELS, code // AL.LEVELS
            span = range(cell * 64**level, (cell + 1) * 64**level)
            # Edge cells must be read word by word.
            assert level == 0 or (r.lo not in span and r.hi not in span)
            covered += span
        assert sorted(covered) == list(range(r.lo, r.hi + 1))
        assert len(r.codes) < 300


def test_no_nested_loop_in_interval_joins(spark):
    sdf = spark.createDataFrame([("g", 0, 0.0, 1.0, "t")], SEG)
    wdf = spark.createDataFrame([("g", 1, 0.0, 1.0, "w")], WORD)
    for df in (AL.refine_segments(sdf, wdf), AL.align_words(sdf, wdf)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_speakers_and_gate(spark):
    jobs = spark.createDataFrame([(g,) for g in "abcde"], "guid string")
    turns = spark.createDataFrame(
        [("a", "S1", 0.0, 1.0), ("a", "S2", 1.0, 2.0), ("a", "S1", 2.0, 3.0), ("b", "S1", 0.0, 1.0), ("d", "S1", 0.0, 1.0), ("d", "S2", 0.0, 1.0)],
        "guid string, speaker string, seg_start double, seg_end double",
    )
    diarized = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "guid string, diarized boolean")
    gated = AL.gate_alignment(jobs, turns, diarized)
    got = {r.guid: (r.n_speakers, r.refine) for r in gated.collect()}
    assert got == {"a": (2, False), "b": (1, True), "c": (0, True), "d": (1, True), "e": (1, True)}
    assert AL.speaker_counts(jobs, turns, diarized).columns == ["guid", "n_speakers"]
    aligned = spark.createDataFrame([("a",), ("a",)], "guid string")
    assert {r.guid for r in AL.needs_alignment(jobs, aligned).collect()} == set("bcde")


def test_corrupt(spark):
    good = "x" * 60
    rows = [
        ("ok", good, [(0.0, 1.0, "t")]), ("blank counts", good, [(0.0, 1.0, " ")]), ("silent", good, [(0.0, 1.0, ""), (1.0, 2.0, None)]),
        ("none", good, []), ("null", good, None), ("garbage", "x", [(0.0, 1.0, "t")]),
    ]
    df = spark.createDataFrame(rows, f"k string, text string, timings {TIMING}")
    got = {r.k: r.c for r in df.select("k", AL.is_corrupt(F.col("text"), F.col("timings")).alias("c")).collect()}
    assert got == {"ok": False, "blank counts": False, "silent": True, "none": True, "null": True, "garbage": True}


def tier(*entries):
    return json.dumps({"start": 0, "tiers": {"phones": {}, "words": {"type": "interval", "entries": entries}}})


def test_alignment_json(spark, tmp_path):
    texts = {
        "ok": tier([0.5, 1, "héllo"], [1.0, 1.25, '"q"']), "empty": tier(), "no_words": '{"tiers": {}}', "no_tiers": "{}",
        "broken": "{", "short": tier([0.5, 1, "a"], [0.5]), "words": tier(["x", 1, "a"]),
    }
    df = spark.createDataFrame(list(texts.items()), "guid string, json string")
    want = [("ok", 1, 0.5, 1.0, "héllo"), ("ok", 2, 1.0, 1.25, '"q"')]
    assert [tuple(r) for r in parse_alignment(df).orderBy("word_index").collect()] == want
    for guid, text in texts.items():
        folder = tmp_path / f"{guid}_aligned"
        folder.mkdir()
        (folder / f"{guid}.json").write_text(text)
    rows = read_alignment(spark, str(tmp_path)).orderBy("word_index").collect()
    assert [tuple(r) for r in rows] == want
