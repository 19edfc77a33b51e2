"""Job lifecycle: fold of events, write-back, recovery, retention."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import file_ext
from voxtab.functions.timing import add_seconds
from voxtab.operators.queue import processing, terminal

GARBAGE = "garbage"
STARTED = "started"
FINAL_OUTCOMES = (C.COMPLETED, C.ERROR)


def _first_garbage(events: DataFrame, cap: int) -> DataFrame:
    """Per guid its first `cap` garbage events, as an array by seq.

    Spark turns the rank filter into a group limit before the shuffle: each task sends
    at most `cap` rows per guid, however many events a guid has.
    """
    by_seq = Window.partitionBy("guid").orderBy("seq")
    return (
        events.where(F.col("outcome") == GARBAGE)
        .select("guid", "seq", "ts", F.row_number().over(by_seq).alias("nth"))
        .where(F.col("nth") <= cap)
        .groupBy("guid")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "ts"))).alias("garbage"))
    )


def fold_lifecycle(
    events: DataFrame, cap: int = C.GARBAGE_CAP, initial: DataFrame | None = None
) -> DataFrame:
    """The state that each guid's events lead to.

    Events count in order of `seq` up to the first terminal one: completed, error, or
    the garbage result that brings the attempt counter to `cap`. `initial` holds
    (guid, attempt_count) to start from, 0 where it has no row; if it has `status` too,
    events of jobs that are neither pending nor processing change nothing and give no row.

    Nothing here walks through a guid's events: the first completed or error event and
    the last event are plain aggregates, and which garbage event is terminal depends
    on the first `cap` of them only. One guid may own any share of the events.
    """
    # Flags instead of outcome names keep this a hash aggregate: text buffers would
    # make Spark sort the events first.
    outcome = F.col("outcome")
    final_seq = F.when(outcome.isin(*FINAL_OUTCOMES), F.col("seq"))
    ends = events.groupBy("guid").agg(
        F.min(final_seq).alias("final_seq"),
        F.min_by(outcome == C.COMPLETED, final_seq).alias("succeeded"),
        F.min_by("ts", final_seq).alias("final_ts"),
        F.max("seq").alias("max_seq"),
        F.max_by(outcome == STARTED, "seq").alias("running"),
    )
    folded = ends.join(_first_garbage(events, cap), "guid", "left")
    if initial is None:
        folded = folded.withColumn("before", F.lit(0))
    else:
        status = F.col("status") if "status" in initial.columns else F.lit(C.PENDING)
        start = initial.select("guid", F.col("attempt_count").alias("before"), status.alias("was"))
        folded = folded.join(start, "guid", "left")
        live = F.coalesce("was", F.lit(C.PENDING)).isin(C.PENDING, C.PROCESSING)
        folded = folded.where(live).drop("was")

    before = F.coalesce("before", F.lit(0))
    nth_fatal = F.greatest(F.lit(cap) - before, F.lit(1))
    fatal = F.get(F.coalesce("garbage", F.array()), (nth_fatal - 1).cast("int"))
    folded = folded.withColumn("before", before).withColumn("fatal", fatal)

    fatal_seq, final_seq = F.col("fatal.seq"), F.col("final_seq")
    quarantined = fatal_seq.isNotNull() & (final_seq.isNull() | (fatal_seq < final_seq))
    stopped = quarantined | final_seq.isNotNull()
    last_seq = F.when(quarantined, fatal_seq).otherwise(F.coalesce(final_seq, "max_seq"))
    folded = folded.withColumn("quarantined", quarantined).withColumn("last_seq", last_seq)

    quarantined = F.col("quarantined")
    kept = F.size(F.filter(F.coalesce("garbage", F.array()), lambda e: e.seq <= F.col("last_seq")))
    status = (
        F.when(quarantined, C.QUARANTINED)
        .when(F.col("succeeded"), C.COMPLETED)
        .when(final_seq.isNotNull(), C.ERROR)
        .when(F.col("running"), C.PROCESSING)
        .otherwise(C.PENDING)
    )
    attempts = F.when(status == C.COMPLETED, 0).otherwise(F.col("before") + kept)
    ended = F.when(quarantined, F.col("fatal.ts")).when(stopped, F.col("final_ts"))
    requeues = kept - F.when(quarantined, 1).otherwise(0)
    return folded.select(
        "guid",
        status.alias("status"),
        attempts.cast("int").alias("attempt_count"),
        "last_seq",
        ended.alias("completed_at"),
        kept.alias("garbage_results"),
        # A requeue drops the stored transcript.
        ((requeues > 0) & (status != C.COMPLETED)).alias("cleared"),
    )


def garbage_verdict(attempts: Column, cap: int = C.GARBAGE_CAP) -> Column:
    """Status after one more garbage result on top of `attempts`."""
    return F.when(attempts + 1 >= cap, C.QUARANTINED).otherwise(C.PENDING)


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs with the outcome of their guid written over them.

    `outcomes` has one row per guid: status, attempt_count, completed_at, cleared, and
    where it completes jobs, transcription and timings. A requeue clears transcript and
    timings; quarantine and error keep what is there and set the completion time.
    """
    for name in ("transcription", "timings"):
        if name not in outcomes.columns:
            outcomes = outcomes.withColumn(name, F.lit(None).cast(jobs.schema[name].dataType))
    new = outcomes.select(
        "guid",
        F.struct(
            "status", "attempt_count", "completed_at", "cleared", "transcription", "timings"
        ).alias("new"),
    )
    hit = F.col("new").isNotNull()
    done = F.coalesce(F.col("new.status") == C.COMPLETED, F.lit(False))
    cleared = F.coalesce("new.cleared", F.lit(False))
    result = {
        name: F.when(done, F.col(f"new.{name}")).when(~cleared, F.col(name))
        for name in ("transcription", "timings")
    }
    result["status"] = F.when(hit, F.col("new.status")).otherwise(F.col("status"))
    result["attempt_count"] = F.when(hit, F.col("new.attempt_count")).otherwise(
        F.col("attempt_count")
    )
    result["completed_at"] = F.coalesce("new.completed_at", "completed_at")
    joined = jobs.join(new, "guid", "left")
    return joined.select(*[result.get(c, F.col(c)).alias(c) for c in jobs.columns])


def recover_stuck(jobs: DataFrame) -> DataFrame:
    """Jobs left in processing go back to pending; attempts stay."""
    stuck = F.col("status") == C.PROCESSING
    return jobs.withColumn("status", F.when(stuck, C.PENDING).otherwise(F.col("status")))


def stuck_count(jobs: DataFrame) -> DataFrame:
    return processing(jobs).agg(F.count("*").alias("recovered"))


def expire(
    jobs: DataFrame, now, ttl_seconds: int = C.RETENTION_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """(expired, kept): finished jobs created a day ago or earlier, and all others."""
    limit = add_seconds(F.lit(now).cast("timestamp"), F.lit(-ttl_seconds))
    old = F.col("created_at") <= limit
    finished = F.col("status").isin(*C.EXPIRABLE_STATUSES)
    gone = F.coalesce(old & finished, F.lit(False))
    return terminal(jobs).where(old), jobs.where(~gone)


def expired_artifacts(expired: DataFrame, limit: int | None = None) -> DataFrame:
    """The files and folders to delete, one row each; nothing is deleted here. With
    `limit` the plan covers that many jobs only, oldest first."""
    if limit is not None:
        expired = expired.orderBy("created_at", "guid").limit(limit)
    parts = [(C.ARTIFACT_ORIGINAL, file_ext(F.col("filename")))]
    parts += [(kind, F.lit(suffix)) for kind, suffix in C.ARTIFACT_SUFFIXES]
    plan = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.concat("guid", suffix).alias("path"))
            for kind, suffix in parts
        ]
    )
    return expired.select("guid", F.explode(plan).alias("p")).select("guid", "p.kind", "p.path")
