import random

import pytest
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.encoding import decode_timings, encode_timings
from voxtab.functions.timing import normalize_ts
from voxtab.operators import scoring as S
from voxtab.operators.ordered import collect_in_order
from voxtab.plans import selection

SEG = "guid string, pass_index int, seg_index int, seg_start double, seg_end double, text string"
WORD = (
    "guid string, pass_index int, seg_index int, word_index bigint, seg_start double, seg_end double, "
    "word_start double, word_end double, probability double"
)


def confidence_rule(words):
    """words: (segment, seg_start, seg_end, start, end, probability)"""
    total = score = 0.0
    for seg, s0, s1, start, end, p in words:
        if p is None or p <= 0:
            continue
        peers = sum(w[0] == seg for w in words)
        length = (s1 - s0) / peers if start is None or end is None else end - start
        total += length
        score += length * p
    return score / total if total > 0 else 0.0


def random_words(rng, n):
    rows = []
    for k in range(n):
        g, p, s = f"g{rng.randint(0, 8)}", rng.randint(0, 4), rng.randint(0, 3)
        start = None if rng.random() < 0.2 else s * 10 + rng.random() * 9
        end = None if rng.random() < 0.2 else s * 10 + rng.random() * 9
        prob = rng.choice([None, 0.0, -0.5, rng.random(), rng.random()])
        rows.append((g, p, s, k, s * 10.0, s * 10.0 + 10, start, end, prob))
    return rows


@pytest.mark.parametrize("by", [("guid", "pass_index"), ("guid", "pass_index", "seg_index")])
def test_confidence(spark, by):
    rows = random_words(random.Random(1), 900)
    df = spark.createDataFrame(rows, WORD)
    got = {tuple(r[k] for k in by): r.confidence for r in S.weighted_confidence(df, by).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[: len(by)], []).append((r[2], *r[4:]))
    assert got.keys() == groups.keys()
    for key, words in groups.items():
        assert got[key] == pytest.approx(confidence_rule(words), abs=1e-9), key


def test_odd_numbers_in_words(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("nan", 0, 0, 0, 0.0, 4.0, 0.0, 1.0, nan), ("nan", 0, 0, 1, 0.0, 4.0, 1.0, 2.0, 0.8),
        ("only", 0, 0, 0, 0.0, 4.0, 0.0, 1.0, nan), ("epoch", 0, 0, 0, 0.0, 4.0, 0.0, 1.7e9, 0.5),
        ("epoch", 0, 0, 1, 0.0, 4.0, 1.0, 2.0, 1.0), ("inf", 0, 0, 0, 0.0, 4.0, 0.0, inf, 0.5), ("inf", 0, 0, 1, 0.0, 4.0, nan, 1.0, 0.5),
    ]
    got = {r.guid: r.confidence for r in S.weighted_confidence(spark.createDataFrame(rows, WORD)).collect()}
    assert got == {"nan": 0.8, "only": 0.0, "epoch": pytest.approx(0.5), "inf": 0.0}


def test_sums_do_not_depend_on_order(spark):
    rows = [("g", 0, 0, k, 0.0, 9.0, k * 0.1, k * 0.1 + 0.05 + k / 7, 1 / (k + 1.5)) for k in range(2000)]
    turned = [("h", *r[1:]) for r in reversed(rows)]
    df = spark.createDataFrame(rows + turned, WORD).repartition(7)
    found = [r.confidence for r in S.weighted_confidence(df).collect()]
    assert found[0] == found[1]


def test_confidence_needs_no_window(spark):
    df = spark.createDataFrame(random_words(random.Random(2), 5), WORD)
    assert "Window" not in S.weighted_confidence(df)._jdf.queryExecution().toString()


SCORE = "guid string, pass_index int, confidence double, word_count bigint, duration_sec double"


def test_scores_and_first_best(spark):
    rows = [
        ("a", 0, 0.8, 14, 20.0), ("a", 1, 0.7, 28, 20.0), ("a", 2, 0.7, 40, 20.0),
        ("zero", 0, 0.1, 5, 0.0), ("zero", 1, 0.9, 5, 0.0),
        ("short", 3, 0.5, 4, 23.0), ("short", 4, 0.5, 5, 23.0),
    ]
    scored = S.score_passes(spark.createDataFrame(rows, SCORE))
    got = {(r.guid, r.pass_index): r for r in scored.collect()}
    assert got["a", 0].adjusted == pytest.approx(0.8 * 0.7 / 1.4)
    assert got["a", 1].adjusted == 0.7
    assert got["zero", 1].wps == 0 and got["zero", 1].adjusted == 0
    assert [got["short", k].suspiciously_short for k in (3, 4)] == [True, False]
    assert not got["zero", 0].suspiciously_short
    best = {r.guid: r.pass_index for r in S.best_pass(scored).collect()}
    assert best == {"a": 1, "zero": 0, "short": 4}


def test_a_pass_that_heard_nothing_scores_zero(spark):
    rows = [
        ("later", 2, 0.5, 9, 0.0), ("later", 1, 0.4, 9, 0.0),  # pass 0 is silent and first
        ("first", 0, 0.5, 9, 0.0), ("first", 3, 0.9, 9, 0.0),
        ("heard", 4, 0.1, 90, 9.0),
        ("below", 0, -0.1, 90, 9.0), ("below", 1, -0.2, 90, 9.0),
    ]
    scored = S.score_passes(spark.createDataFrame(rows, SCORE))
    best = {r.guid: (r.pass_index, r.confidence) for r in S.best_pass(scored).collect()}
    assert best == {"later": (0, 0.0), "first": (0, 0.5), "heard": (4, 0.1), "below": (2, 0.0)}


def test_fan_out(spark):
    df = spark.createDataFrame([("a",), ("b",)], "guid string")
    rows = S.fan_out_passes(df).orderBy("guid", "pass_index").collect()
    assert len(rows) == 10
    assert [tuple(r)[1:] for r in rows[:5]] == list(C.PASSES)
    assert "CartesianProduct" not in S.fan_out_passes(df)._jdf.queryExecution().toString()


def test_assembly_in_segment_order(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", "  ", " word ", "two words", "x\n"]) for _ in range(10000)]
    rows = [("a", k, 0.0, 1.0, t) for k, t in enumerate(texts)] + [("b", 0, 0.0, 1.0, "solo")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "guid string, seg_index int, seg_start double, seg_end double, text string")
    got = {r.guid: r for r in S.assemble_transcript(S.clean_segments(df)).collect()}
    want = " ".join(t.strip() for t in texts if t.strip())
    assert got["a"].transcript == want and got["a"].word_count == len(want.split())
    assert got["b"].transcript == "solo"


def test_lists_of_structs_keep_nulls(spark):
    rows = [("a", k, None if k % 3 else float(k)) for k in range(9000)]
    df = spark.createDataFrame(rows, "guid string, k int, v double").repartition(7)
    item = F.struct(F.col("v").alias("v"))
    got = collect_in_order(df, ["guid"], "k", item, "out").collect()[0].out
    assert [r.v for r in got] == [v for _, _, v in rows]


def test_timestamps_of_either_shape(spark):
    plain = spark.createDataFrame([(3,)], "t int")
    listed = spark.createDataFrame([([1.5, 2.0],), ([],)], "t array<double>")
    assert plain.select(normalize_ts(plain, "t")).collect()[0][0] == 3.0
    assert [r[0] for r in listed.select(normalize_ts(listed, "t")).collect()] == [1.5, None]


def test_timings_round_trip(spark):
    df = spark.createDataFrame([(None,), ("",), ('[{"start": 0.5, "end": 2, "text": "\\u00e9 \\"q\\""}]',)], "j string")
    rows = df.select(decode_timings(F.col("j")).alias("t"))
    got = [r.t for r in rows.collect()]
    assert got[:2] == [[], []]
    assert tuple(got[2][0]) == (0.5, 2.0, 'é "q"')
    again = rows.select(decode_timings(encode_timings(F.col("t"))).alias("t"))
    assert [r.t for r in again.collect()] == got


def test_selection_end_to_end(spark):
    """Pass 1 has better words, but too few of them for the length of the audio."""
    segs, words = [], []
    texts = {0: [" we are here. ", "We are here now ", "  "], 1: ["we", "now", ""]}
    for p, parts in texts.items():
        for k, text in enumerate(parts):
            segs.append(("g", p, k, k * 2.0, k * 2.0 + 2, text))
            for w in range(len(text.split())):
                words.append(("g", p, k, w, k * 2.0, k * 2.0 + 2, k * 2.0, k * 2.0 + 1, 0.6 + 0.3 * p))
    segs = spark.createDataFrame(segs, SEG)
    words = spark.createDataFrame(words, WORD)
    durations = spark.createDataFrame([("g", 5.0)], "guid string, duration_sec double")
    row = selection.select_transcripts(segs, words, durations).collect()[0]
    assert row.transcription == "we are here.  now"
    assert [tuple(t) for t in row.timings] == [(0.0, 2.0, "we are here."), (2.0, 4.0, "We are here now")]
    unknown = durations.where("false")
    assert selection.select_transcripts(segs, words, unknown).collect()[0].transcription == "we are here.  now"


def test_alignment_text(spark):
    rows = [("g", 0, 0, 0.0, 1.0, " no no "), ("g", 0, 1, 1.0, 2.0, "no no no yes"), ("g", 0, 2, 2.0, 3.0, " ")]
    df = spark.createDataFrame(rows, SEG)
    assert selection.alignment_text(df).collect()[0].text == "no no yes"
