"""Alignment: speaker gate, words to segments, refined segment bounds, checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.functions.text import is_garbage

# Time cells for interval matching. A cell of level 0 lasts four seconds, one of each
# further level 64 times as long as one of the level before: the highest lasts more than
# a hundred years. Segments are cut to the span of their recording's words, so bounds
# without end cover no more than that. Results are exact: wherever a cell may lie partly
# outside an interval, the times themselves are compared.
CELL_SECONDS = 4.0
RADIX_BITS = 6
LEVELS = 6
# Doubles beyond this are no longer whole seconds apart.
LAST_CELL = float(1 << 51)


def _cell(time: Column) -> Column:
    low, high = F.lit(-LAST_CELL), F.lit(LAST_CELL)
    return F.floor(F.least(F.greatest(time / CELL_SECONDS, low), high)).cast("bigint")


def _within(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments that may have words, with `lo` and `hi`: the first and last cell that both
    they and the words of their recording reach."""
    spans = _timed(words).groupBy("guid").agg(
        F.min("word_start").alias("w_first"), F.max("word_start").alias("w_last")
    )
    lo = _cell(F.greatest("seg_start", "w_first"))
    hi = _cell(F.least("seg_end", "w_last"))
    # NaN is no bound: Spark would order it behind all numbers.
    known = ~F.isnan("seg_start") & ~F.isnan("seg_end") & (F.col("seg_start") <= F.col("seg_end"))
    placed = segments.where(known).join(spans, "guid")
    placed = placed.withColumn("lo", lo).withColumn("hi", hi).drop("w_first", "w_last")
    return placed.where(F.col("lo") <= F.col("hi"))


def _up(cell: Column, level: int) -> Column:
    return F.shiftright(cell, RADIX_BITS * level)


def _code(cell: Column, level: int) -> Column:
    return cell * LEVELS + level


def with_speakers(jobs: DataFrame, turns: DataFrame, diarized: DataFrame) -> DataFrame:
    """Jobs with `n_speakers`. Without a successful diarization one speaker is assumed;
    a successful one without turns gives 0."""
    heard = turns.groupBy("guid").agg(F.countDistinct("speaker").alias("n"))
    ran = diarized.where(F.col("diarized")).select("guid", F.lit(True).alias("ran")).distinct()
    n = F.when(F.col("ran"), F.coalesce("n", F.lit(0))).otherwise(1)
    return (
        jobs.join(ran, "guid", "left")
        .join(heard, "guid", "left")
        .withColumn("n_speakers", n.cast("bigint"))
        .drop("ran", "n")
    )


def speaker_counts(jobs: DataFrame, turns: DataFrame, diarized: DataFrame) -> DataFrame:
    return with_speakers(jobs.select("guid"), turns, diarized)


def gate_alignment(jobs: DataFrame, turns: DataFrame, diarized: DataFrame) -> DataFrame:
    """Jobs with `n_speakers` and `refine`: false where more than one speaker talks."""
    return with_speakers(jobs, turns, diarized).withColumn("refine", F.col("n_speakers") <= 1)


def needs_alignment(jobs: DataFrame, aligned: DataFrame) -> DataFrame:
    """Jobs whose alignment output does not exist yet."""
    return jobs.join(aligned.select("guid"), "guid", "left_anti")


def align_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Each segment with each word that starts inside it, both ends included; a word on
    a shared bound goes to both segments. Segments without words keep one row with
    null word columns.

    An equi-join on time cells: a segment takes the finest level at which it spans at
    most 65 cells, a word is in one cell of every level. So one recording spreads over
    many tasks, and a segment of any length makes a bounded number of rows. Segments
    without words are added, so a segment with most of the words is no key of a join.
    """
    lo, hi = F.col("lo"), F.col("hi")
    bounds = _within(segments, words)
    codes = _run(_up(lo, LEVELS - 1), _up(hi, LEVELS - 1), LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        fits = _up(hi, n) - _up(lo, n) <= 1 << RADIX_BITS
        codes = F.when(fits, _run(_up(lo, n), _up(hi, n), n)).otherwise(codes)
    pieces = bounds.withColumn("code", F.explode(codes)).drop("lo", "hi")

    cell = _cell(F.col("word_start"))
    grid = F.array(*[_code(_up(cell, n), n) for n in range(LEVELS)])
    placed = _timed(words).withColumn("code", F.explode(grid))
    inside = F.col("word_start").between(F.col("seg_start"), F.col("seg_end"))
    pairs = (
        pieces.join(placed, ["guid", "code"])
        .where(inside)
        .drop("code")
    )
    matched = pairs.select("guid", "seg_index").distinct()
    silent = segments.join(matched, ["guid", "seg_index"], "left_anti")
    return pairs.unionByName(silent, allowMissingColumns=True)


def _timed(words: DataFrame) -> DataFrame:
    start = F.col("word_start")
    return words.where(start.isNotNull() & ~F.isnan(start))


def _run(first: Column, last: Column, level: int) -> Column:
    codes = F.sequence(_code(first, level), _code(last, level), F.lit(LEVELS).cast("bigint"))
    return F.when(first <= last, codes).otherwise(F.array().cast("array<bigint>"))


def _inner(lo: Column, hi: Column, level: int) -> tuple[Column, Column]:
    """First and last cell of a level that lie wholly between the cells lo and hi."""
    size = 1 << (RADIX_BITS * level)
    return _up(lo + size, level), _up(hi, level) - 1


def _cover(lo: Column, hi: Column) -> Column:
    """Cells of all levels that tile the level-0 cells lo..hi. Those of higher levels
    touch neither lo nor hi; each level adds at most 65 on either side, the highest
    what is left."""
    parts, first, last = [], lo, hi
    for n in range(LEVELS - 1):
        up_first, up_last = _inner(lo, hi, n + 1)
        split = up_first <= up_last
        left = F.when(split, F.shiftleft(up_first, RADIX_BITS) - 1).otherwise(last)
        right = F.when(split, F.shiftleft(up_last + 1, RADIX_BITS)).otherwise(last + 1)
        parts += [_run(first, left, n), _run(right, last, n)]
        first, last = up_first, up_last
    return F.concat(*parts, _run(first, last, LEVELS - 1))


def refine_segments(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with `refined_start` and `refined_end`: the start of the first and the
    end of the last matching word in file order, or the segment's own bounds if no
    word starts inside it.

    Only the first and last word of a stretch of time matter, so a segment is not
    paired with all words inside it. Words are summed up per cell of each higher level
    and, in cells of level 0, per start time; a segment reads the cells that tile it.
    """
    cell = _cell(F.col("word_start"))
    codes = F.array(*[_code(_up(cell, n), n) for n in range(LEVELS)])
    at = F.when(F.pmod("code", F.lit(LEVELS)) == 0, F.col("word_start"))
    cells = (
        _timed(words)
        .select("guid", "word_index", "word_start", "word_end", F.explode(codes).alias("code"))
        .withColumn("at", at)
        .groupBy("guid", "code", "at")
        .agg(
            F.min("word_index").alias("first_index"),
            F.min_by("word_start", "word_index").alias("first_start"),
            F.max("word_index").alias("last_index"),
            F.max_by("word_end", "word_index").alias("last_end"),
        )
    )

    pieces = _within(segments.select("guid", "seg_index", "seg_start", "seg_end"), words).select(
        "guid", "seg_index", "seg_start", "seg_end",
        F.explode(_cover(F.col("lo"), F.col("hi"))).alias("code"),
    )
    inside = F.col("at").isNull() | F.col("at").between(F.col("seg_start"), F.col("seg_end"))
    found = (
        pieces.join(cells, ["guid", "code"])
        .where(inside)
        .groupBy("guid", "seg_index")
        .agg(
            F.min_by("first_start", "first_index").alias("refined_start"),
            F.max_by("last_end", "last_index").alias("refined_end"),
            F.lit(True).alias("matched"),
        )
    )
    joined = segments.join(found, ["guid", "seg_index"], "left")
    for name, own in (("refined_start", "seg_start"), ("refined_end", "seg_end")):
        bound = F.when(F.col("matched"), F.col(name)).otherwise(F.col(own))
        joined = joined.withColumn(name, bound)
    return joined.drop("matched")


def is_corrupt(text: Column, timings: Column) -> Column:
    """Garbage text, no timings, or timings whose texts are all empty. A blank text is
    not empty."""
    silent = F.forall(timings, lambda t: F.coalesce(t["text"], F.lit("")) == "")
    return is_garbage(text) | F.coalesce((F.size(timings) <= 0) | silent, F.lit(True))
