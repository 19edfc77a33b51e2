"""The lifecycle fold as a stateful stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxtab import constants as C
from voxtab.operators.lifecycle import FINAL_OUTCOMES, GARBAGE, STARTED
from voxtab.schemas import JOB_EVENTS
from voxtab.sources.jobs import evolve_schema

# What decides a guid's state, whatever the order in which its events arrive: the
# first completed or error event, the first `cap` garbage events and the last event.
STATE = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("created_us", T.LongType()),
        T.StructField("final_seq", T.LongType()),
        T.StructField("final_us", T.LongType()),
        T.StructField("succeeded", T.BooleanType()),
        T.StructField("garbage_seq", T.ArrayType(T.LongType())),
        T.StructField("garbage_us", T.ArrayType(T.LongType())),
        T.StructField("max_seq", T.LongType()),
        T.StructField("running", T.BooleanType()),
        T.StructField("estimate", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)
NEW_JOB = (0, None, None, None, None, [], [], None, None, 0, None)

# The states of a group of guids, column by column, and when each is over.
DUE = "due_ms"
GROUP_STATE = T.StructType(
    [
        T.StructField("guid", T.ArrayType(T.StringType())),
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in STATE.fields],
        T.StructField(DUE, T.ArrayType(T.LongType())),
    ]
)
# Groups of guids. A stream keeps the number that it starts with.
GROUPS = 2048

UPDATES = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        # Grows with each update of a guid: its highest version is its latest state.
        T.StructField("version", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempt_count", T.IntegerType()),
        T.StructField("last_seq", T.LongType()),
        T.StructField("completed_us", T.LongType()),
        T.StructField("expired", T.BooleanType()),
        # What the update changes in the queue.
        T.StructField("pending_delta", T.LongType()),
        T.StructField("wait_delta", T.LongType()),
    ]
)


KINDS = {
    f.name: {T.LongType(): "Int64", T.IntegerType(): "int32", T.BooleanType(): "bool"}.get(f.dataType, "object")
    for f in UPDATES.fields
}


def decisive_rows(events: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The rows of a batch that can matter to the state of their guid."""
    events = events.sort_values("seq", kind="stable")
    garbage = events[events["outcome"] == GARBAGE].groupby("guid").head(cap)
    final = events[events["outcome"].isin(FINAL_OUTCOMES)].groupby("guid").head(1)
    last = events.groupby("guid").tail(1)
    first = events.sort_values("ts", kind="stable").groupby("guid").head(1)
    estimated = events.dropna(subset="processing_time_est")
    estimated = estimated.sort_values("processing_time_est", kind="stable").groupby("guid").tail(1)
    keep = garbage.index
    for part in (final, last, first, estimated):
        keep = keep.union(part.index)
    return events.loc[keep]


def known(value):
    """A number that may be unknown, as states keep it."""
    return value if value == value else None


class LifecycleFold:
    """The states of a group of guids after a batch of their events. States travel with the events
    in Arrow batches, those of a group at once, so a guid costs no calls of its own."""

    def __init__(self, cap: int, retention_ms: int):
        self.cap = cap
        self.retention_ms = retention_ms

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = self._load(state)
        mark = state.getCurrentWatermarkMs()
        before: dict = {}
        if not state.hasTimedOut:
            for batch in batches:
                columns = (batch[n].tolist() for n in ("guid", "seq", "us", "outcome", "processing_time_est"))
                for guid, seq, us, outcome, estimate in zip(*columns, strict=True):
                    if guid not in before:
                        before[guid], jobs[guid] = self._begin(jobs.get(guid), mark)
                    job = jobs[guid]
                    self._merge(job, seq, us, outcome)
                    if estimate is not None and estimate == estimate:
                        job["estimate"] = max(job["estimate"], int(estimate))
        rows = []
        for guid, old in before.items():
            job = jobs[guid]
            out = self._settle(job)
            job["version"], job["status"] = job["version"] + 1, out["status"]
            over = out["completed_us"] is not None and job["created_us"] is not None
            job[DUE] = max(self._due(job), mark + 1) if over else None
            rows.append(self._row(guid, old, job, out, expired=False))
        # As with a state of its own, a guid that gets events now leaves with a later batch.
        for guid in [g for g, job in jobs.items() if g not in before and job[DUE] is not None and job[DUE] < mark]:
            job = jobs.pop(guid)
            left = job | {"version": job["version"] + 1}
            rows.append(self._row(guid, job, left, self._settle(job), expired=True))
        self._store(jobs, state)
        if rows:
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=KINDS[n]) for n in UPDATES.names})

    def _begin(self, old: dict | None, mark: int) -> tuple[dict, dict]:
        """A guid's state before its events, and a copy that takes them."""
        old = old or dict(zip(STATE.names, NEW_JOB, strict=True))
        job = dict(old)
        if job["max_seq"] is None:
            # A guid may return once its job has left. The watermark is then over a
            # day further on, so versions keep growing.
            job["version"] = max(0, mark)
        return old, job

    def _load(self, state: GroupState) -> dict:
        if not state.exists:
            return {}
        guids, *columns = state.get
        names = GROUP_STATE.names[1:]
        jobs = {g: dict(zip(names, v, strict=True)) for g, *v in zip(guids, *columns, strict=True)}
        for job in jobs.values():
            for name in ("garbage_seq", "garbage_us"):
                job[name] = [float("nan") if v is None else v for v in job[name]]
        return jobs

    def _store(self, jobs: dict, state: GroupState) -> None:
        if not jobs:
            state.remove()
            return
        columns = [list(jobs)]
        for name in GROUP_STATE.names[1:]:
            values = [job[name] for job in jobs.values()]
            if name in ("garbage_seq", "garbage_us"):
                columns.append([[known(v) for v in some] for some in values])
            else:
                columns.append([known(v) for v in values])
        state.update(tuple(columns))
        due = [job[DUE] for job in jobs.values() if job[DUE] is not None]
        if due:
            state.setTimeoutTimestamp(min(due))

    def _due(self, job: dict) -> int:
        """Timeouts know milliseconds; states keep microseconds."""
        return int(job["created_us"]) // 1000 + self.retention_ms

    def _merge(self, job: dict, seq: int, us: int, outcome: str) -> None:
        if us == us and (job["created_us"] is None or us < job["created_us"]):
            job["created_us"] = us
        if outcome == GARBAGE:
            known = list(zip(job["garbage_seq"], job["garbage_us"], strict=True))
            first = sorted([*known, (seq, us)])[: self.cap]
            job["garbage_seq"] = [s for s, _ in first]
            job["garbage_us"] = [u for _, u in first]
        elif outcome in FINAL_OUTCOMES and (job["final_seq"] is None or seq < job["final_seq"]):
            job["final_seq"], job["final_us"] = seq, us
            job["succeeded"] = outcome == C.COMPLETED
        if job["max_seq"] is None or seq > job["max_seq"]:
            job["max_seq"], job["running"] = seq, outcome == STARTED

    def _settle(self, job: dict) -> dict:
        """State as of now, by the rule of the batch fold."""
        end, end_us = job["final_seq"], job["final_us"]
        status = C.COMPLETED if job["succeeded"] else C.ERROR
        if len(job["garbage_seq"]) >= self.cap:
            fatal = job["garbage_seq"][self.cap - 1]
            if end is None or fatal < end:
                end, end_us, status = fatal, job["garbage_us"][self.cap - 1], C.QUARANTINED
        if end is None:
            status = C.PROCESSING if job["running"] else C.PENDING
        last = job["max_seq"] if end is None else end
        attempts = sum(seq <= last for seq in job["garbage_seq"])
        return {
            "status": status,
            "attempt_count": 0 if status == C.COMPLETED else attempts,
            "last_seq": last,
            "completed_us": end_us,
        }

    def _row(self, guid, old: dict, job: dict, out: dict, expired: bool) -> dict:
        before, now = old["status"] == C.PENDING, job["status"] == C.PENDING
        return {
            "guid": guid, "version": job["version"], **out, "expired": expired,
            "pending_delta": int(now) - int(before),
            "wait_delta": now * job["estimate"] - before * old["estimate"],
        }


def lifecycle_stream(
    events: DataFrame,
    cap: int = C.GARBAGE_CAP,
    lateness: str = "1 day",
    retention_seconds: int = C.RETENTION_SECONDS,
    groups: int = GROUPS,
) -> DataFrame:
    """A stream of job events to a stream of job states, one row per guid and batch.

    Events may come in any order within the allowed lateness. The state of a finished
    job goes a day after its first event, with a last row marked `expired`; a later
    event of that guid starts a new job.

    Each Arrow batch is first cut down to the rows that can matter, at most cap + 4 per
    guid, so a guid with a large part of all events sends little through the shuffle. Guids
    share `groups` states by their hash: a batch of events costs one call a group and little a
    guid, and writes the states of the groups that it meets. The number holds for the life of
    the stream's checkpoint.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield decisive_rows(batch, cap)

    fold = LifecycleFold(cap, retention_seconds * 1000)

    def step(key, batches, state):
        yield from fold(key, batches, state)

    events = evolve_schema(events, {"processing_time_est": (None, "bigint")})
    slim = events.select(*JOB_EVENTS.names).mapInPandas(combine, JOB_EVENTS)
    updates = (
        slim.withWatermark("ts", lateness)
        .withColumn("us", F.unix_micros("ts"))
        .withColumn("group", F.pmod(F.xxhash64("guid"), F.lit(groups)))
        .groupBy("group")
        .applyInPandasWithState(
            step,
            outputStructType=UPDATES,
            stateStructType=GROUP_STATE,
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )
    return updates.withColumn("completed_at", F.timestamp_micros("completed_us")).drop(
        "completed_us"
    )


def latest_states(updates: DataFrame) -> DataFrame:
    """The newest state of each guid, expired ones left out."""
    names = [c for c in updates.columns if c not in ("guid", "version")]
    newest = F.max_by(F.struct(*names), F.col("version")).alias("s")
    return (
        updates.groupBy("guid").agg(newest).select("guid", "s.*").where(~F.col("expired"))
        .drop("expired", "pending_delta", "wait_delta")
    )
