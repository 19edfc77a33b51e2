"""Queue reports: filters, listing, status, waiting times, backlog."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab import constants as C
from voxtab.functions.text import duration_text
from voxtab.functions.timing import ETA_FORMAT, add_seconds, eta_text, status_eta
from voxtab.operators.prefix import preceding_sums
from voxtab.schemas import TIMINGS


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == C.PENDING)


def processing(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == C.PROCESSING)


def in_flight(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*C.IN_FLIGHT_STATUSES))


def terminal(jobs: DataFrame) -> DataFrame:
    """Finished jobs in the sense of retention: completed, error, quarantined."""
    return jobs.where(F.col("status").isin(*C.EXPIRABLE_STATUSES))


def lookup_jobs(jobs: DataFrame, guids: DataFrame) -> DataFrame:
    """One row per distinct guid asked for, with `found`; guids compare as raw text.

    The job table is only ever filtered by the asked guids, so Spark can send a small
    request to the jobs and need not shuffle the table for it.
    """
    asked = guids.select("guid").distinct()
    hits = jobs.join(asked, "guid", "left_semi").withColumn("found", F.lit(True))
    answer = asked.join(hits, "guid", "left")
    return answer.withColumn("found", F.coalesce("found", F.lit(False)))


def list_jobs(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first; a missing completion time is empty text."""
    completed = F.date_format("completed_at", ETA_FORMAT)
    return jobs.select(
        "guid",
        "filename",
        "status",
        F.col("created_at").alias("submitted_at"),
        F.coalesce(completed, F.lit("")).alias("completed_at"),
        "processing_time_est",
    ).orderBy(F.desc("submitted_at"), "guid")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"))


def _total_seconds() -> Column:
    return F.coalesce(F.sum("processing_time_est"), F.lit(0)).cast("bigint")


def backlog(jobs: DataFrame) -> DataFrame:
    """Seconds of work over all pending jobs; 0 if there are none."""
    return pending(jobs).agg(_total_seconds().alias("backlog_sec"))


def queue_summary(jobs: DataFrame) -> DataFrame:
    return (
        pending(jobs)
        .agg(
            F.count("*").alias("total_pending"),
            _total_seconds().alias("total_wait_sec"),
        )
        .withColumn("total_wait", duration_text(F.col("total_wait_sec")))
    )


def monitor_eta(jobs: DataFrame) -> DataFrame:
    """Per pending job: its own submission time plus its own estimate, no queue."""
    done = add_seconds(F.col("created_at"), F.col("processing_time_est"))
    return pending(jobs).select(
        "guid",
        "filename",
        F.col("created_at").alias("submitted_at"),
        eta_text(done).alias("estimated_completion_utc"),
    )


def next_pending(jobs: DataFrame, k: int = 1) -> DataFrame:
    """The k oldest pending jobs; guid breaks ties."""
    return pending(jobs).orderBy("created_at", "guid").limit(k)


def wait_ahead(jobs: DataFrame) -> DataFrame:
    """In-flight jobs with `ahead_sec`: the work of in-flight jobs created strictly
    before. Jobs created at the same instant do not wait for each other."""
    live = in_flight(jobs)
    instant = F.unix_micros("created_at")
    sums = preceding_sums(live, instant, F.col("processing_time_est"))
    ahead = F.coalesce("before", F.lit(0)).cast("bigint")
    return (
        live.withColumn("key", instant)
        .join(sums, "key", "left")
        .withColumn("ahead_sec", ahead)
        .drop("key", "before")
    )


def status_report(jobs: DataFrame) -> DataFrame:
    """Every job as its client sees it.

    Only in-flight jobs need the queue ahead of them, and nothing but their own few
    columns for it; all others, with their transcripts, pass through without a shuffle.
    """
    status = F.col("status")
    live = wait_ahead(jobs.select("guid", "status", "created_at", "processing_time_est"))
    eta = status_eta(F.col("created_at"), F.col("ahead_sec"), F.col("processing_time_est"))
    live = live.withColumn("eta", eta)
    rest = jobs.where(status.isNull() | ~status.isin(*C.IN_FLIGHT_STATUSES))
    rest = rest.withColumn("eta", F.lit(None).cast("string"))
    rows = rest.unionByName(live.drop("ahead_sec"), allowMissingColumns=True)

    done = status.isin(*C.DONE_STATUSES)
    failed = status.isin(*C.FAILED_STATUSES)
    known = done | failed | status.isin(*C.IN_FLIGHT_STATUSES)
    public = (
        F.when(done, C.COMPLETED)
        .when(failed, C.ERROR)
        .when(status.isin(*C.IN_FLIGHT_STATUSES), status)
    )
    message = F.when(failed, C.MSG_FAILED).when(status == C.PROCESSING, C.MSG_PROCESSING)
    text = F.coalesce("transcription", F.lit(""))
    timings = F.coalesce("timings", F.array().cast(TIMINGS))
    return rows.select(
        "guid",
        public.alias("status"),
        F.when(done, text).alias("transcription"),
        F.when(done, timings).alias("timings"),
        message.alias("message"),
        F.col("eta").alias("estimated_completion_utc"),
        F.when(F.coalesce(known, F.lit(False)), F.lit(None).cast(T.StringType()))
        .otherwise(C.MSG_UNKNOWN_STATUS)
        .alias("error"),
    )
