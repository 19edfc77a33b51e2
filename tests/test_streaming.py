import datetime as dt
import os
import random

from test_lifecycle import EVENTS, T0, walk

from voxtab.operators.lifecycle import fold_lifecycle
from voxtab.streaming import monitor
from voxtab.streaming.dedupe import dedupe_submissions
from voxtab.streaming.guard import guard_submissions
from voxtab.streaming.lifecycle import latest_states, lifecycle_stream
from voxtab.streaming.runner import run_available

OUTCOMES = ["submitted", "started", "garbage", "recovered", "completed", "error"]


def write_parts(spark, rows, schema, folder, parts):
    for k in range(parts):
        part = spark.createDataFrame(rows[k::parts], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))


def read_parts(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        (f"g{rng.randint(0, 60)}", s, T0 + dt.timedelta(seconds=s), rng.choices(OUTCOMES, [3, 3, 6, 2, 1, 1])[0])
        for s in range(600)
    ]
    batch = spark.createDataFrame(rows, EVENTS)
    rng.shuffle(rows)
    write_parts(spark, rows, EVENTS, tmp_path / "in", 4)
    stream = lifecycle_stream(read_parts(spark, EVENTS, tmp_path / "in"), cap=3)
    states = latest_states(run_available(stream, "lifecycle", str(tmp_path / "out")))
    columns = ["guid", "status", "attempt_count", "last_seq", "completed_at"]
    got = sorted(map(tuple, states.select(columns).collect()), key=str)
    assert got == sorted(map(tuple, fold_lifecycle(batch).select(columns).collect()), key=str)


def test_finished_jobs_leave_after_a_day(spark, tmp_path):
    later = T0 + dt.timedelta(days=4)
    parts = [
        [("done", 0, T0, "submitted"), ("done", 1, T0, "completed"), ("open", 2, T0, "submitted")],
        [("late", 3, later, "completed")],
        [("done", 4, later, "submitted")],
    ]
    seen = []
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lifecycle_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
        updates = run_available(stream, "lifecycle", str(tmp_path / "out"))
        seen.append({r.guid: r.status for r in latest_states(updates).collect()})
    assert seen[0] == {"done": "completed", "open": "pending"}
    assert seen[1] == {"open": "pending", "late": "completed"}
    assert seen[2] == {"open": "pending", "late": "completed", "done": "pending"}


def test_dedupe_within_a_day(spark, tmp_path):
    schema = "guid string, submitted_at timestamp"
    rows = [(f"g{k % 20}", T0 + dt.timedelta(minutes=k)) for k in range(100)]
    write_parts(spark, rows, schema, tmp_path / "in", 3)
    stream = dedupe_submissions(read_parts(spark, schema, tmp_path / "in"))
    got = [r.guid for r in run_available(stream, "dedupe", str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({g for g, _ in rows})


def test_monitor_follows_the_queue(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (f"g{rng.randint(0, 30)}", s, T0 + dt.timedelta(seconds=s), rng.choices(OUTCOMES, [5, 3, 4, 2, 1, 1])[0])
        for s in range(300)
    ]
    estimates = {f"g{k}": 50 + k for k in range(25)}
    rows = [(*r, estimates.get(r[0])) for r in rows]
    schema = EVENTS + ", processing_time_est bigint"
    write_parts(spark, rows, schema, tmp_path / "in", 3)
    query, folder = monitor.queue_monitor_stream(
        read_parts(spark, schema, tmp_path / "in"), str(tmp_path / "out"), every=None
    )
    query.awaitTermination()
    history = monitor.queue_history(spark, folder).orderBy("batch_id").collect()
    by_guid = {}
    for g, s, _, o, _ in rows:
        by_guid.setdefault(g, []).append((s, o))
    waiting = [g for g, r in by_guid.items() if walk(r, 3, 0)[0] == "pending"]
    assert len(history) >= 3
    assert history[-1].total_pending == len(waiting)
    assert history[-1].total_wait_sec == sum(estimates.get(g, 0) for g in waiting)


def test_hot_guid_is_cut_down_before_the_shuffle():
    import pandas as pd

    from voxtab.streaming.lifecycle import decisive_rows

    batch = pd.DataFrame(
        {
            "guid": "hot", "seq": range(10000), "ts": pd.date_range(T0, periods=10000, freq="s"),
            "outcome": "garbage", "processing_time_est": range(10000),
        }
    )
    assert len(decisive_rows(batch.sample(frac=1, random_state=1).reset_index(drop=True), 3)) <= 7


def test_tiles_of_ten_thousand_batches():
    for base in (2, 3, 32):
        for batch in [*range(500), 9998, 9999, 10**9]:
            upto = 0
            for level, place in monitor.tiles(batch, base):
                assert place * base**level == upto
                upto = (place + 1) * base**level
            assert upto == batch + 1
    assert len(monitor.tiles(9999)) < 3 * monitor.BASE


def test_totals_are_rolled_up(spark, tmp_path):
    rng, folder, base, n = random.Random(5), str(tmp_path / "m"), 3, 29
    deltas = [(rng.randint(-3, 5), rng.randint(-90, 200)) for _ in range(n)]
    for k, row in enumerate(deltas):
        df = spark.createDataFrame([row], "pending_delta bigint, wait_delta bigint")
        for _ in range(1 + (k in (8, 17, 26))):  # a batch that is run again, its sums too
            monitor.add_deltas(df, k, folder, base)
    history = monitor.queue_history(spark, folder, base).orderBy("batch_id").collect()
    for r in history:
        done = deltas[: r.batch_id + 1]
        assert (r.total_pending, r.total_wait_sec) == (sum(d[0] for d in done), sum(d[1] for d in done))
    assert [r.batch_id for r in history] == [26, 27, 28]
    files = [f for _, _, names in os.walk(f"{folder}/deltas") for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * base * 4


def replayed(rows, outcomes, jobs, day=86400):
    """The guard's rule, one row after another. rows: (guid, at, name); outcomes: (guid, at, status)."""
    held = {g: (created, status in ("completed", "error", "quarantined")) for g, status, created in jobs}
    admitted = set()
    events = sorted([(at, 1, name, g) for g, at, name in rows] + [(at, 0, status, g) for g, at, status in outcomes])
    for at, kind, what, g in events:
        if g in held and held[g][1] and held[g][0] + day <= at:
            del held[g]
        if kind == 0:
            if g in held:
                held[g] = (held[g][0], what in ("completed", "error", "quarantined"))
        elif g not in held:
            held[g] = (at, False)
            admitted.add((g, at, what))
    return admitted


def test_guard_equals_a_replay(spark, tmp_path):
    rng = random.Random(11)
    at = lambda hours: T0 + dt.timedelta(hours=hours)
    rows = [(f"g{rng.randint(0, 12)}", rng.randint(0, 240), f"n{k}") for k in range(300)]
    told = [(f"g{rng.randint(0, 12)}", rng.randint(0, 240), rng.choice(["completed", "error", "pending", "processing"])) for _ in range(120)]
    jobs = [("g0", "pending", -500), ("g1", "completed", -500), ("g2", "processed", -500), ("g3", "error", -1)]
    schema, said = "guid string, submitted_at timestamp, name string", "guid string, at timestamp, status string"
    # Three days of rows a batch, in any order within.
    for part in range(4):
        span = range(part * 72, part * 72 + 72)
        for name, data, kind in (("in", rows, schema), ("out", told, said)):
            some = [(g, at(h), x) for g, h, x in data if h in span]
            rng.shuffle(some)
            spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = guard_submissions(
        read_parts(spark, schema, tmp_path / "in"), read_parts(spark, said, tmp_path / "out"),
        spark.createDataFrame([(g, s, at(h)) for g, s, h in jobs], "guid string, status string, created_at timestamp"),
        lateness="10 days",
    )
    got = run_available(stream, "guard", str(tmp_path / "rows")).collect()
    assert len(got) == len(rows)
    want = replayed(rows, told, jobs, day=24)
    mine = {(r.guid, int((r.submitted_at - T0).total_seconds()) // 3600, r.name) for r in got if r.reason == "admitted"}
    assert mine == want and {g for g, _, _ in want} >= {"g1", "g3"}


def test_an_open_job_holds_its_guid_for_ever(spark, tmp_path):
    schema = "guid string, submitted_at timestamp"
    jobs = spark.createDataFrame([("open", "processing", T0), ("done", "completed", T0)], "guid string, status string, created_at timestamp")
    seen = []
    for days in (2, 40, 41):
        when = T0 + dt.timedelta(days=days)
        spark.createDataFrame([("open", when), ("done", when)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (tmp_path / "out").mkdir(exist_ok=True)
        stream = guard_submissions(
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")),
            spark.readStream.schema("guid string, at timestamp, status string").parquet(str(tmp_path / "out")), jobs,
        )
        rows = run_available(stream, "guard", str(tmp_path / "rows")).collect()
        seen.append(sorted((r.guid, r.reason) for r in rows if r.submitted_at == when))
    refused = "GUID already exists"
    assert seen == [[("done", "admitted"), ("open", refused)], [("done", refused), ("open", refused)], [("done", refused), ("open", refused)]]


def ended(query):
    """What the state store held after each batch of a stream that has run to its end."""
    query.awaitTermination()
    return [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]


def written(stream, folder):
    from voxtab.session import stream_session

    with stream_session(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(availableNow=True).start(f"{folder}/rows")


def test_guids_share_states(spark, tmp_path):
    """Several batches and leaving jobs, and far fewer states than guids."""
    n, later = 2000, T0 + dt.timedelta(days=4)
    parts = [
        [(f"g{k}", k, T0 + dt.timedelta(seconds=k % 50), "completed" if k % 2 else "submitted") for k in range(n)],
        [(f"g{k}", n + k, T0 + dt.timedelta(seconds=60), "started") for k in range(0, n, 4)],
        [("new", 2 * n, later, "submitted")],
        [("new", 2 * n + 1, later, "submitted")],
        [("g1", 2 * n + 2, later, "submitted")],
    ]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lifecycle_stream(read_parts(spark, EVENTS, tmp_path / "in"), groups=7)
    states = ended(written(stream, tmp_path / "out"))
    assert states and max(states) <= 7
    updates = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out/rows")
    got = {r.guid: r.status for r in latest_states(updates).collect()}
    want = {f"g{k}": "processing" if k % 4 == 0 else "pending" for k in range(0, n, 2)}
    assert got == want | {"new": "pending", "g1": "pending"}
    assert updates.where("expired").count() == n // 2


def test_guids_share_guards(spark, tmp_path):
    """Jobs by the thousand are a few states, whose guids are free again one by one."""
    schema, n = "guid string, submitted_at timestamp", 2000
    known = [(f"g{k}", "completed" if k % 2 else "pending", T0 + dt.timedelta(seconds=k)) for k in range(n)]
    jobs = spark.createDataFrame(known, "guid string, status string, created_at timestamp")
    (tmp_path / "out").mkdir()
    days = [T0 + dt.timedelta(days=1, seconds=1000), T0 + dt.timedelta(days=30)]
    for at in days:
        rows = [(f"g{k}", at) for k in range(0, n, 5)] + [("new", at)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = guard_submissions(
        read_parts(spark, schema, tmp_path / "in"),
        spark.readStream.schema("guid string, at timestamp, status string").parquet(str(tmp_path / "out")),
        jobs, lateness="1 second", groups=5,
    )
    # A state, a timer and the timer's index for each group.
    states = ended(written(stream, tmp_path / "rows"))
    assert states and max(states) <= 3 * 5
    rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows/rows").collect()
    got = {(r.guid, days.index(r.submitted_at)) for r in rows if r.reason == "admitted"}
    first = {f"g{k}" for k in range(0, n, 5) if k % 2 and k <= 1000}
    second = {f"g{k}" for k in range(0, n, 5) if k % 2 and k > 1000}
    assert got == {(g, 0) for g in first | {"new"}} | {(g, 1) for g in second}
