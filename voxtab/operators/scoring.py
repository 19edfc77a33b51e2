"""Candidate transcripts: pass fan-out, confidence, word rate, selection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import strip_text, word_count
from voxtab.functions.timing import (
    adjusted_confidence,
    is_suspiciously_short,
    normalize_ts,
    words_per_second,
)
from voxtab.operators.ordered import collect_in_order

PASS_FIELDS = (
    "pass_index",
    "temperature",
    "patience",
    "beam_size",
    "condition_on_previous_text",
)


def fan_out_passes(jobs: DataFrame, passes=C.PASSES) -> DataFrame:
    """Each job once per pass, with that pass's parameters."""
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(PASS_FIELDS, row, strict=True)])
        for row in passes
    ]
    fanned = jobs.withColumn("p", F.explode(F.array(*rows)))
    return fanned.select(*jobs.columns, "p.*")


def clean_segments(segments: DataFrame) -> DataFrame:
    """Segments with trimmed text, the blank ones dropped, bounds as double."""
    return (
        segments.withColumn("text", strip_text(F.col("text")))
        .where(F.col("text") != "")
        .withColumn("seg_start", normalize_ts(segments, "seg_start"))
        .withColumn("seg_end", normalize_ts(segments, "seg_end"))
    )


def assemble_transcript(segments: DataFrame, keys: tuple[str, ...] = ("guid",)) -> DataFrame:
    """Cleaned segments as one text per key, in segment order."""
    words = word_count(F.col("transcript"))
    return (
        collect_in_order(segments, list(keys), "seg_index", F.col("text"), "texts")
        .withColumn("transcript", F.array_join("texts", " "))
        .withColumn("word_count", words)
        .drop("texts")
    )


def _weighted(by: list[str], words: DataFrame) -> DataFrame:
    """Per segment: sums of duration and of duration times probability.

    A word without both bounds lasts an equal share of its segment; the share counts
    all words of the segment, also those without probability. A probability that is NaN
    is none. Addends are whole numbers, so that sums do not depend on their order and equal
    passes have equal scores.
    """
    p = F.when((F.col("probability") > 0) & ~F.isnan("probability"), F.col("probability"))
    length = F.col("word_end") - F.col("word_start")
    unbounded = length.isNull()
    sums = words.groupBy(*by).agg(
        F.count("*").alias("n_words"),
        _exact_sum(F.when(p.isNotNull(), length)).alias("known_len"),
        _exact_sum(length * p).alias("known_score"),
        F.count(F.when(unbounded, p)).alias("shared_n"),
        _exact_sum(F.when(unbounded, p)).alias("shared_p"),
        F.max(F.col("seg_end") - F.col("seg_start")).alias("seg_len"),
    )
    share = F.col("seg_len") / F.col("n_words")
    return sums.select(
        *by,
        _sum_of(F.col("known_len"), share * F.col("shared_n")).alias("total_len"),
        _sum_of(F.col("known_score"), share * F.col("shared_p")).alias("total_score"),
    )


def _exact_sum(value: Column) -> Column:
    """Sum of whole millionths and, apart from them, of millionths of these. What is beyond 10^12
    counts as nothing."""
    micro = F.when(F.abs(value) < 1e12, value * 1e6)
    whole = F.floor(micro)
    rest = F.round((micro - whole) * 1e6).cast("bigint")
    return F.try_sum(whole) / F.lit(1e6) + F.try_sum(rest) / F.lit(1e12)


def _sum_of(*parts: Column) -> Column:
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return total


def weighted_confidence(
    words: DataFrame, by: tuple[str, ...] = ("guid", "pass_index")
) -> DataFrame:
    """Mean word probability, weighted by word duration, per `by`; 0 where no word
    counts. `by` may go down to ("guid", "pass_index", "seg_index").

    Both steps are sums, combined before each shuffle: no window over a segment.
    """
    segment = ["guid", "pass_index", "seg_index"]
    sums = _weighted(segment, words)
    if list(by) != segment:
        sums = sums.groupBy(*by).agg(
            _exact_sum(F.col("total_len")).alias("total_len"),
            _exact_sum(F.col("total_score")).alias("total_score"),
        )
    score = F.when(F.col("total_len") > 0, F.col("total_score") / F.col("total_len"))
    return sums.select(*by, F.coalesce(score, F.lit(0.0)).alias("confidence"))


def pass_word_counts(segments: DataFrame) -> DataFrame:
    """Words of each pass's transcript. Segments are joined by a space, so the counts
    of the cleaned segments add up and no transcript has to be built for it."""
    return segments.groupBy("guid", "pass_index").agg(
        F.sum(word_count(F.col("text"))).cast("bigint").alias("word_count")
    )


def score_passes(scores: DataFrame) -> DataFrame:
    """Adds word rate, adjusted confidence and the short flag to rows that hold
    confidence, word_count and duration_sec."""
    words, duration = F.col("word_count"), F.col("duration_sec")
    return (
        scores.withColumn("wps", words_per_second(words, duration))
        .withColumn("adjusted", adjusted_confidence(F.col("confidence"), F.col("wps")))
        .withColumn("suspiciously_short", is_suspiciously_short(words, duration))
    )


def best_pass(scores: DataFrame, passes=C.PASSES) -> DataFrame:
    """Per guid the pass of highest adjusted confidence, the first one of equals. A pass
    without a row heard nothing and scores 0; it wins where it comes first and no pass
    scores more."""
    order = F.struct(F.col("adjusted"), (-F.col("pass_index")).alias("first"))
    best = F.max(F.struct(order.alias("order"), "pass_index", "confidence")).alias("b")
    indexes = F.array(*[F.lit(row[0]) for row in passes])
    silent = F.array_min(F.array_except(indexes, F.collect_set("pass_index")))
    top = scores.groupBy("guid").agg(best, silent.alias("silent"))

    adjusted, own = F.col("b.order.adjusted"), F.col("b.pass_index")
    silent_wins = (adjusted < 0) | ((adjusted == 0) & (F.col("silent") < own))
    silent_wins = F.coalesce(silent_wins & F.col("silent").isNotNull(), F.lit(False))
    zero = F.lit(0.0)
    return top.select(
        "guid",
        F.when(silent_wins, F.col("silent")).otherwise(own).alias("pass_index"),
        F.when(silent_wins, zero).otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(silent_wins, zero).otherwise(adjusted).alias("adjusted"),
    )


def select_best(segments: DataFrame, best: DataFrame) -> DataFrame:
    """Only the segments of the winning pass."""
    return segments.join(best, ["guid", "pass_index"], "left_semi")
