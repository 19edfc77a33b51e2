"""The duplicate guard as a stream that knows what became of the jobs."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxtab import constants as C

# The guids of a group that are taken: when their jobs were created, and whether these have
# finished; and when the group's timer is due.
TAKEN = T.StructType(
    [
        T.StructField("guid", T.ArrayType(T.StringType())),
        T.StructField("created_us", T.ArrayType(T.LongType())),
        T.StructField("finished", T.ArrayType(T.BooleanType())),
        T.StructField("timer_ms", T.LongType()),
    ]
)
# Groups of guids. A stream keeps the number that it starts with.
GROUPS = 2048


class GuidGuard(StatefulProcessor):
    """The guard for a group of guids, whose states are read and written at once."""

    def __init__(self, names: list[str], retention_us: int):
        self.names = names
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("taken", TAKEN)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        taken, timer = self._load()
        taken.update((j["guid"], (j["created_us"], j["finished"])) for j in initialState.jobs)
        self._store(taken, timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        taken, timer = self._load()
        before = dict(taken)
        out = Row(*self.names, "reason")
        for row in sorted(rows, key=lambda r: (r["__us"], r["__status"] is None, r["__order"])):
            guid, us, status = row["guid"], row["__us"], row["__status"]
            held = taken.get(guid)
            if held is not None and self._free(held, us):
                del taken[guid]
                held = None
            if status is not None:
                if held is not None:
                    taken[guid] = (held[0], status in C.EXPIRABLE_STATUSES)
                continue
            if held is None:
                taken[guid] = (us, False)
            yield out(*[row[n] for n in self.names], C.ADMITTED if held is None else C.REJECT_KNOWN_GUID)
        if taken != before:
            self._store(taken, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        taken, timer = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = {g: held for g, held in taken.items() if not self._free(held, now * 1000)}
        self._store(left, None if timer == now else timer)
        return iter(())

    def close(self) -> None:
        pass

    def _free(self, held, us: int) -> bool:
        return held[1] and held[0] + self.retention_us <= us

    def _load(self) -> tuple[dict, int | None]:
        state = self.state.get()
        if state is None:
            return {}, None
        guids, created, finished, timer = state
        return dict(zip(guids, zip(created, finished, strict=True), strict=True)), timer

    def _store(self, taken: dict, timer: int | None) -> None:
        """The state of the group and its one timer, which frees memory only: rows are judged by their
        own time. It is due when no row from before the first guid is free can come any more."""
        ends = [held[0] + self.retention_us for held in taken.values() if held[1]]
        due = -(-min(ends) // 1000) if ends else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if taken:
            created, finished = zip(*taken.values(), strict=True)
            self.state.update((list(taken), list(created), list(finished), due))
        else:
            self.state.clear()


def guard_submissions(
    submissions: DataFrame,
    outcomes: DataFrame,
    jobs: DataFrame | None = None,
    time: str = "submitted_at",
    lateness: str = "1 hour",
    retention_seconds: int = C.RETENTION_SECONDS,
    groups: int = GROUPS,
) -> DataFrame:
    """A stream of submissions with a valid guid to the same with `reason`: admitted, or the
    guid exists already.

    A guid is taken from the moment that a submission is admitted, or that its job in `jobs`
    (guid, status, created_at: the job table as the stream starts) was created. It is free again
    when its job has finished and was created `retention_seconds` ago, however long that takes;
    `outcomes` (guid, status, at) is the stream that says so. A job that goes back to pending
    holds its guid. Rows of a guid count in order of their time, an outcome before a submission,
    submissions of one instant by their other columns. Rows that come later than `lateness`
    allows are dropped by the watermark.

    One guid's submissions meet in one task; its state is two numbers. Guids share `groups`
    states by their hash, which are read and written once a batch. The number holds for the
    life of the stream's checkpoint.
    """
    group = F.pmod(F.xxhash64("guid"), F.lit(groups)).alias("__group")
    names = submissions.columns
    instant = lambda c: F.unix_micros(F.col(c))
    order = F.to_json(F.struct(*sorted(set(names) - {time, "guid"})), {"ignoreNullFields": "false"})
    asked = submissions.withWatermark(time, lateness).withColumns(
        {"__us": instant(time), "__status": F.lit(None).cast("string"), "__order": order}
    )
    told = outcomes.select("guid", "status", F.col("at").alias(time)).withWatermark(time, lateness)
    told = told.select(
        "guid", F.col("status").alias("__status"), F.col("status").alias("__order"), time, instant(time).alias("__us")
    ).where(F.col("__status").isNotNull())
    both = asked.unionByName(told, allowMissingColumns=True).where(F.col(time).isNotNull())
    initial = None
    if jobs is not None:
        # A guid has one job; of several the one that holds it longest counts.
        finished = F.coalesce(F.col("status").isin(*C.EXPIRABLE_STATUSES), F.lit(False))
        known = jobs.select("guid", finished.alias("finished"), F.unix_micros("created_at").alias("created_us"))
        known = known.where("created_us is not null").groupBy("guid").agg(
            F.max("created_us").alias("created_us"), F.bool_and("finished").alias("finished")
        )
        known = known.groupBy(group).agg(F.collect_list(F.struct("guid", "created_us", "finished")).alias("jobs"))
        initial = known.groupBy("__group")
    return both.withColumn("__group", group).groupBy("__group").transformWithState(
        GuidGuard(names, retention_seconds * 1_000_000),
        outputStructType=T.StructType([*submissions.schema.fields, T.StructField("reason", T.StringType())]),
        outputMode="Append",
        timeMode="eventTime",
        initialState=initial,
    )
