"""From the segments and words of all passes to one transcript per recording."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.functions.text import remove_boundary_duplicates, squash_repeats
from voxtab.operators.ordered import collect_in_order
from voxtab.operators.scoring import (
    best_pass,
    clean_segments,
    pass_word_counts,
    score_passes,
    select_best,
    weighted_confidence,
)


def pass_scores(segments: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Every pass that has cleaned segments or words, with counts, confidence, scores.
    A recording of unknown duration counts as length 0."""
    counts = pass_word_counts(segments)
    confidence = weighted_confidence(words)
    scores = counts.join(confidence, ["guid", "pass_index"], "full").join(
        durations.select("guid", "duration_sec"), "guid", "left"
    )
    return score_passes(
        scores.select(
            "guid",
            "pass_index",
            F.coalesce("word_count", F.lit(0)).alias("word_count"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
        )
    )


def best_segments(segments: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Cleaned segments of each recording's best pass.

    Passes are scored on counts and sums. The winners, one short row per recording, go to
    the segments in a join that Spark plans by their size.
    """
    cleaned = clean_segments(segments)
    best = best_pass(pass_scores(cleaned, words, durations)).select("guid", "pass_index")
    return select_best(cleaned, best)


def transcripts_of(
    segments: DataFrame, deduplicate: bool = True, bounds=("seg_start", "seg_end")
) -> DataFrame:
    """Per guid `transcription`, without boundary duplicates, and `timings`, from the
    segments of one pass. `bounds` names the columns that the timings take."""
    start, end = bounds
    item = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col("text"))
    listed = collect_in_order(segments, ["guid"], "seg_index", item, "timings")
    text = F.array_join(F.col("timings.text"), " ")
    if deduplicate:
        text = remove_boundary_duplicates(text)
    return listed.select("guid", text.alias("transcription"), "timings")


def select_transcripts(
    segments: DataFrame, words: DataFrame, durations: DataFrame, deduplicate: bool = True
) -> DataFrame:
    return transcripts_of(best_segments(segments, words, durations), deduplicate)


def alignment_text(segments: DataFrame) -> DataFrame:
    """Per guid the text that goes to the aligner: trimmed segments in order, words
    said four or more times in a row said once."""
    cleaned = clean_segments(segments)
    listed = collect_in_order(cleaned, ["guid"], "seg_index", F.col("text"), "texts")
    return listed.select("guid", squash_repeats(F.array_join("texts", " ")).alias("text"))
