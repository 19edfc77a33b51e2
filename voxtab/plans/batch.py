"""All pending jobs in one go, from audio check to the written-back job table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import is_garbage
from voxtab.operators.alignment import gate_alignment, is_corrupt, refine_segments
from voxtab.operators.audio import resolve_audio
from voxtab.operators.lifecycle import apply_outcomes, garbage_verdict
from voxtab.operators.queue import pending
from voxtab.plans.selection import best_segments, transcripts_of
from voxtab.schemas import TIMINGS
from voxtab.session import cut
from voxtab.sources.job_store import is_stored, read_store, store_outcomes


def job_outcomes(
    jobs: DataFrame,
    listing: DataFrame,
    segments: DataFrame,
    words: DataFrame,
    durations: DataFrame,
    turns: DataFrame,
    diarized: DataFrame,
    aligned: DataFrame,
    now,
    failed: DataFrame | None = None,
    cap: int = C.GARBAGE_CAP,
    deduplicate: bool = True,
) -> DataFrame:
    """One outcome per pending job.

    No audio, or a guid in `failed` (the recogniser gave up): error. Garbage text,
    before or after alignment: one attempt more, requeued or quarantined. Else
    completed, with timings refined where a single speaker talks.

    Segments and words of recordings that are not pending, have no audio or failed leave
    before anything is scored, so a batch costs what is in it and not what was ever
    recognised. The gate and the winning segments are each kept behind a checkpoint, since
    two later steps read them.
    """
    todo = resolve_audio(pending(jobs), listing).select("guid", "attempt_count", "audio_found")
    gated = cut(gate_alignment(todo, turns, diarized))
    wanted = gated.where(F.col("audio_found")).select("guid")
    if failed is not None:
        wanted = wanted.join(failed.select("guid"), "guid", "left_anti")

    heard = [df.join(wanted, "guid", "left_semi") for df in (segments, words, durations)]
    best = best_segments(*heard)
    best = cut(best.select("guid", "seg_index", "seg_start", "seg_end", "text"))
    single = gated.where(F.col("refine")).select("guid")
    refined = refine_segments(best, aligned.join(single, "guid", "left_semi"))
    texts = transcripts_of(refined, deduplicate, ("refined_start", "refined_end"))

    rows = gated.join(texts, "guid", "left")
    if failed is None:
        broken = F.lit(False)
    else:
        gave_up = failed.select("guid", F.lit(True).alias("gave_up")).distinct()
        rows = rows.join(gave_up, "guid", "left")
        broken = F.coalesce("gave_up", F.lit(False))
    text = F.coalesce("transcription", F.lit(""))
    timings = F.coalesce("timings", F.array().cast(TIMINGS))
    status = (
        F.when(~F.col("audio_found") | broken, C.ERROR)
        .when(
            is_garbage(text) | is_corrupt(text, timings),
            garbage_verdict(F.col("attempt_count"), cap),
        )
        .otherwise(C.COMPLETED)
    )
    rows = rows.withColumn("status", status)
    status = F.col("status")
    done = status == C.COMPLETED
    garbage = status.isin(C.PENDING, C.QUARANTINED)
    attempts = F.when(done, 0).otherwise(F.col("attempt_count") + garbage.cast("int"))
    ended = F.when(status != C.PENDING, F.lit(now).cast("timestamp"))
    return rows.select(
        "guid",
        "status",
        attempts.cast("int").alias("attempt_count"),
        ended.alias("completed_at"),
        (status == C.PENDING).alias("cleared"),
        F.when(done, text).alias("transcription"),
        F.when(done, timings).alias("timings"),
    )


def process_jobs(jobs: DataFrame, *inputs: DataFrame, now, **options) -> DataFrame:
    """The job table after every pending job has been processed once; arguments as in
    `job_outcomes`. Jobs that are not pending pass through without a shuffle."""
    outcomes = job_outcomes(jobs, *inputs, now=now, **options)
    others = jobs.where(F.col("status").isNull() | (F.col("status") != C.PENDING))
    return apply_outcomes(pending(jobs), outcomes).unionByName(others)


def process_store(
    spark: SparkSession, path: str, batch_id: int, *inputs: DataFrame, now, **options
) -> bool:
    """Process every pending job of a stored job table once and store the outcomes; arguments as in
    `job_outcomes`. A batch that is stored already does nothing and gives False, so a batch that
    was cut short can simply be run again."""
    if is_stored(spark, path, batch_id):
        return False
    outcomes = job_outcomes(read_store(spark, path, as_of=batch_id - 1), *inputs, now=now, **options)
    return store_outcomes(spark, path, batch_id, outcomes)
