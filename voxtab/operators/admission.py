"""Admission of submissions: checks, duplicates, waiting time, new job rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import is_valid_guid
from voxtab.functions.timing import add_seconds, eta_text, processing_estimate
from voxtab.operators.prefix import preceding_sums
from voxtab.operators.queue import backlog
from voxtab.sources.jobs import append_jobs

__all__ = ["admit", "admission_eta", "append_jobs"]


def admit(submissions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Submissions with `reason`: `admitted`, or the first check that failed.

    Checks in order: file, file name, guid present, guid valid, guid unused. Of valid
    submissions with one new guid the first to arrive is admitted, exactly one: those
    without an arrival come last, and equal arrivals are told apart by their other
    columns. Those that fail a check on their own columns skip the joins.
    """
    guid = F.col("guid")
    own_reason = (
        F.when(~F.coalesce("has_file", F.lit(False)), C.REJECT_NO_FILE)
        .when(F.col("filename") == "", C.REJECT_NO_NAME)
        .when(F.coalesce(guid, F.lit("")) == "", C.REJECT_NO_GUID)
        .when(~is_valid_guid(guid), C.REJECT_BAD_GUID)
    )
    checked = submissions.withColumn("reason", own_reason)
    refused = checked.where(F.col("reason").isNotNull())
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    # Never null here; saying so keeps both uses of `firsts` one plan, run once.
    valid = valid.withColumn("guid", F.coalesce("guid", F.lit("")))

    # One row per guid, combined on the map side, decides for all its submissions. The
    # job table only meets these rows: a small batch goes to the jobs, not the reverse.
    others = sorted(set(submissions.columns) - {"arrival", "guid"})
    order = F.struct(F.col("arrival").isNull().alias("late"), "arrival", *others)
    valid = valid.withColumn("order", order)
    firsts = valid.groupBy("guid").agg(F.min("order").alias("first"))
    known = jobs.select("guid").join(firsts, "guid", "left_semi")
    fresh = firsts.join(known, "guid", "left_anti")
    decided = valid.join(fresh, "guid", "left")
    wins = F.col("first").isNotNull() & F.col("order").eqNullSafe(F.col("first"))
    lost = decided.where(~wins).withColumn("reason", F.lit(C.REJECT_KNOWN_GUID))
    # Rows alike in every column tie: they are counted, and one of them wins.
    alike = decided.where(wins).groupBy(*submissions.columns).agg(F.count("*").alias("n"))
    ranked = alike.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    reason = F.when(F.col("i") == 1, C.ADMITTED).otherwise(C.REJECT_KNOWN_GUID)
    won = ranked.withColumn("reason", reason)
    names = checked.columns
    return won.select(*names).unionByName(lost.select(*names)).unionByName(refused)


def admission_eta(admitted: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """Admitted submissions with their estimate and the time they should be done: now,
    plus the pending backlog, plus admitted submissions that arrived before, plus
    their own estimate. `now` is a timestamp column or literal."""
    own = processing_estimate(F.col("duration_sec"))
    rows = admitted.withColumn("processing_time_est", own)
    sums = preceding_sums(rows, F.col("arrival"), F.col("processing_time_est"))
    waiting = backlog(jobs).scalar()
    ahead = (F.coalesce("before", F.lit(0)) + waiting).cast("bigint")
    done = add_seconds(F.lit(now), F.col("ahead_sec") + F.col("processing_time_est"))
    return (
        rows.join(sums.withColumnRenamed("key", "arrival"), "arrival", "left")
        .withColumn("ahead_sec", ahead)
        .withColumn("estimated_completion_utc", eta_text(done))
        .drop("before")
    )
