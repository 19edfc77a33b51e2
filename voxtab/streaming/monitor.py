"""The queue summary, kept up to date from the stream of job states."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import duration_text
from voxtab.session import run_folder, stream_session
from voxtab.streaming.lifecycle import lifecycle_stream

# Batches, or sums of batches, that are summed up into one row of the next level.
BASE = 32
DELTAS = "level int, place bigint, pending_delta bigint, wait_delta bigint"


def queue_deltas(updates: DataFrame) -> DataFrame:
    """How much one batch of job states changes the pending count and the wait."""
    return updates.agg(
        F.coalesce(F.sum("pending_delta"), F.lit(0)).alias("pending_delta"),
        F.coalesce(F.sum("wait_delta"), F.lit(0)).alias("wait_delta"),
    )


# Row `place` of level k holds the sum of the BASE^k batches from place * BASE^k on. It lies in the
# folder of its place modulo twice BASE, where it takes the place of one whose batches are part of a
# sum of the next level by then. So a level has twice BASE files at most.


def _slot(level: int, place: int, base: int) -> str:
    return f"{level}-{place % (2 * base)}"


def tiles(batch_id: int, base: int = BASE) -> list[tuple[int, int]]:
    """The rows (level, place) that make up all batches up to this one, oldest first."""
    found, level, end = [], 0, batch_id + 1
    while end:
        found += [(level, place) for place in reversed(range(end - end % base, end))]
        end //= base
        level += 1
    return found[::-1]


def _rows(spark, folder: str) -> DataFrame:
    return spark.read.schema(f"{DELTAS}, slot string").parquet(f"{folder}/deltas")


def _read(spark, folder: str, wanted: list[tuple[int, int]], base: int) -> DataFrame:
    rows = _rows(spark, folder).where(F.col("slot").isin([_slot(k, p, base) for k, p in wanted]))
    return rows.where(F.concat_ws("-", "level", "place").isin([f"{k}-{p}" for k, p in wanted]))


def add_deltas(deltas: DataFrame, batch_id: int, folder: str, base: int = BASE) -> None:
    """Store one batch's row and the sums that it completes. The same batch again writes the same."""
    spark, place, level = deltas.sparkSession, batch_id, 0
    rows = deltas.withColumns({"level": F.lit(0), "place": F.lit(place).cast("bigint")})
    while True:
        names = [n.split()[0] for n in DELTAS.split(", ")]
        rows.select(*names).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/deltas/slot={_slot(level, place, base)}"
        )
        if (place + 1) % base:
            return
        parts = [(level, p) for p in range(place + 1 - base, place + 1)]
        rows, place, level = queue_deltas(_read(spark, folder, parts, base)), place // base, level + 1
        rows = rows.withColumns({"level": F.lit(level), "place": F.lit(place).cast("bigint")})


def queue_monitor_stream(
    events: DataFrame,
    folder: str | None = None,
    cap: int = C.GARBAGE_CAP,
    every: str | None = "30 seconds",
    base: int = BASE,
    **lifecycle,
):
    """Start the monitor over events that carry `processing_time_est`: (query, folder).

    Each batch of states adds one row to the folder, so a batch costs what it changes and
    not what is stored; a batch that is run again overwrites its own row. Every `base` rows are
    summed up into one, and so are those, so the folder grows with the logarithm of the
    number of batches. With `every=None` the stream runs over what is there and ends."""
    spark = events.sparkSession
    folder = folder or run_folder(spark, "monitor")

    def add(batch: DataFrame, batch_id: int) -> None:
        add_deltas(queue_deltas(batch), batch_id, folder, base)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    with stream_session(spark):
        query = (
            lifecycle_stream(events, cap, **lifecycle)
            .writeStream.foreachBatch(add)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**trigger)
            .start()
        )
    return query, folder


def queue_history(spark, folder: str, base: int = BASE) -> DataFrame:
    """Pending jobs and waiting time after batch `batch_id`: after each of the last batches, up to
    `base` of them, and further back after each that completed a sum. The few rows, `base` a level,
    fit a single window."""
    newest = _rows(spark, folder).where("level = 0").agg(F.max("place")).first()[0]
    rows = _read(spark, folder, tiles(newest, base) if newest is not None else [], base)
    last = (F.col("place") + 1) * F.pow(F.lit(base), F.col("level")).cast("bigint") - 1
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("batch_id", last).select(
        "batch_id",
        F.sum("pending_delta").over(so_far).alias("total_pending"),
        F.sum("wait_delta").over(so_far).alias("total_wait_sec"),
    ).withColumn("total_wait", duration_text(F.col("total_wait_sec")))
