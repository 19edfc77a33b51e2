import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.timing import processing_estimate
from voxtab.operators import admission as A
from voxtab.operators import queue as Q
from voxtab.operators.prefix import preceding_sums
from voxtab.sources.jobs import append_jobs, conform_jobs, evolve_schema, read_jobs, write_jobs

T0 = dt.datetime(2026, 1, 1)
JOB = "guid string, filename string, status string, created_at timestamp, processing_time_est bigint, attempt_count int"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def jobs(spark, *rows):
    """(guid, status, seconds after T0, estimate)"""
    data = [(g, "talk.mp3", s, at(t), e, 0) for g, s, t, e in rows]
    return spark.createDataFrame(data, JOB)


def test_prefix_sums_over_all_magnitudes(spark):
    rng = random.Random(1)
    keys = [rng.choice([1, 10**3, 10**7, 10**13]) * rng.randint(-50, 50) for _ in range(400)]
    rows = [(k, rng.randint(0, 9)) for k in keys] + [(None, 5)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    got = {r.key: r.before for r in preceding_sums(df, F.col("k"), F.col("v")).collect()}
    want = {k: sum(v for o, v in rows if o is not None and o < k) for k in keys}
    assert got == want


def test_wait_counts_only_strictly_earlier_jobs(spark):
    df = jobs(
        spark,
        ("a", "pending", 0, 50), ("b", "processing", 0, 60), ("c", "pending", 5, 70),
        ("d", "completed", 1, 999), ("e", "pending", 6, 80),
    )
    got = {r.guid: r.ahead_sec for r in Q.wait_ahead(df).collect()}
    assert got == {"a": 0, "b": 0, "c": 110, "e": 180}


def test_wait_reads_the_jobs_once_for_its_sums(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write_jobs(jobs(spark, *[(f"g{k}", "pending", k % 7, 10) for k in range(50)]), path)
    df = Q.wait_ahead(read_jobs(spark, path)).select("guid", "ahead_sec")
    assert df.count() == 50
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("FileScan") == 2
    assert plan.count("Exchange SinglePartition") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_status_report(spark):
    df = conform_jobs(
        jobs(
            spark,
            ("p", "pending", 0, 50), ("r", "processing", 10, 60), ("c", "completed", 0, 1),
            ("o", "processed", 0, 1), ("x", "error", 0, 1), ("q", "quarantined", 0, 1),
            ("w", "odd", 0, 1), ("n", None, 0, 1),
        )
    )
    got = {r.guid: r for r in Q.status_report(df).collect()}
    assert len(got) == 8
    assert got["p"].status == "pending" and got["p"].message is None
    assert got["p"].estimated_completion_utc == "2026-01-01 00:00:50 UTC"
    assert got["r"].estimated_completion_utc == "2026-01-01 00:02:00 UTC"
    assert got["r"].message == C.MSG_PROCESSING
    assert (got["c"].status, got["c"].transcription, got["c"].timings) == ("completed", "", [])
    assert got["o"].status == "completed"
    assert got["x"].status == got["q"].status == "error"
    assert got["q"].message == C.MSG_FAILED and got["q"].transcription is None
    assert got["w"].error == got["n"].error == C.MSG_UNKNOWN_STATUS
    assert got["p"].error is None


def test_terminal_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "jobs")
    conform_jobs(jobs(spark, ("p", "pending", 0, 50), ("c", "completed", 0, 1))).write.parquet(path)
    plan = Q.status_report(read_jobs(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().splitlines()[0].startswith("Union")


def test_listing_and_head(spark):
    df = conform_jobs(
        jobs(spark, ("b", "pending", 0, 1), ("a", "pending", 0, 1), ("z", "error", 9, 1))
    )
    listed = Q.list_jobs(df).collect()
    assert [r.guid for r in listed] == ["z", "a", "b"]
    assert {r.completed_at for r in listed} == {""}
    assert [r.guid for r in Q.next_pending(df).collect()] == ["a"]
    assert [r.guid for r in Q.next_pending(df, 5).collect()] == ["a", "b"]


def test_counts_and_summary(spark):
    df = jobs(spark, ("a", "pending", 0, 90000), ("b", "pending", 0, 5), ("c", "error", 0, 7))
    assert Q.backlog(df).collect()[0].backlog_sec == 90005
    row = Q.queue_summary(df).collect()[0]
    assert (row.total_pending, row.total_wait) == (2, "1 day, 1:00:05")
    none = Q.queue_summary(df.where("status = 'x'")).collect()[0]
    assert (none.total_pending, none.total_wait_sec, none.total_wait) == (0, 0, "0:00:00")
    eta = {r.guid: r.estimated_completion_utc for r in Q.monitor_eta(df).collect()}
    assert eta == {"a": "2026-01-02 01:00:00 UTC", "b": "2026-01-01 00:00:05 UTC"}
    assert {r.status: r.n_jobs for r in Q.status_counts(df).collect()} == {"pending": 2, "error": 1}
    assert Q.terminal(df).count() == 1 and Q.in_flight(df).count() == 2


def test_lookup(spark):
    df = jobs(spark, ("a", "pending", 0, 1), ("b", "pending", 0, 1))
    asked = spark.createDataFrame([("a",), ("a",), ("A",), (None,)], "guid string")
    got = {r.guid: r.found for r in Q.lookup_jobs(df, asked).collect()}
    assert got == {"a": True, "A": False, None: False}


@pytest.mark.parametrize("seconds, want", [(0.0, 45), (0.1, 50), (15.1, 50), (15.2, 55), (600.0, 245), (3600.0, 1240)])
def test_estimate(spark, seconds, want):
    df = spark.createDataFrame([(seconds,)], "d double")
    assert df.select(processing_estimate(F.col("d"))).collect()[0][0] == want


SUB = "arrival bigint, has_file boolean, filename string, guid string, duration_sec double"
G = "0" * 31


def test_admission_order_and_duplicates(spark):
    rows = [
        (1, False, "", None, 1.0), (2, True, "", None, 1.0), (3, True, "a.mp3", None, 1.0),
        (4, True, "a.mp3", "", 1.0), (5, True, "a.mp3", "nope", 1.0), (6, True, "a.mp3", G + "1", 1.0),
        (7, True, "a.mp3", G + "2", 15.1), (8, True, "a.mp3", G + "2", 1.0), (9, True, "a.mp3", G + "3", 30.0),
        (10, None, "a.mp3", G + "4", 1.0), (0, False, "a.mp3", G + "2", 1.0),
    ]
    known = jobs(spark, (G + "1", "completed", 0, 1), ("p", "pending", 0, 100))
    checked = A.admit(spark.createDataFrame(rows, SUB), known)
    reasons = {r.arrival: r.reason for r in checked.collect()}
    assert reasons == {
        1: C.REJECT_NO_FILE, 2: C.REJECT_NO_NAME, 3: C.REJECT_NO_GUID, 4: C.REJECT_NO_GUID,
        5: C.REJECT_BAD_GUID, 6: C.REJECT_KNOWN_GUID, 7: C.ADMITTED, 8: C.REJECT_KNOWN_GUID,
        9: C.ADMITTED, 10: C.REJECT_NO_FILE, 0: C.REJECT_NO_FILE,
    }
    admitted = checked.where(F.col("reason") == C.ADMITTED)
    eta = A.admission_eta(admitted, known, T0)
    got = {r.arrival: (r.ahead_sec, r.estimated_completion_utc) for r in eta.collect()}
    assert got == {7: (100, "2026-01-01 00:02:30 UTC"), 9: (150, "2026-01-01 00:03:25 UTC")}
    grown = append_jobs(known, eta, T0)
    assert grown.count() == 4
    new = grown.where(F.col("guid") == G + "2").collect()[0]
    assert (new.status, new.created_at, new.processing_time_est, new.attempt_count) == ("pending", T0, 50, 0)


def test_migration_adds_a_default_once(spark, tmp_path):
    legacy = spark.createDataFrame([("legacy", "old.mp3")], "guid string, filename string")
    once = evolve_schema(legacy, {"attempt_count": 0})
    assert once.collect()[0].attempt_count == 0
    touched = once.withColumn("attempt_count", F.lit(2))
    assert evolve_schema(touched, {"attempt_count": 0}).collect()[0].attempt_count == 2
    path = str(tmp_path / "jobs")
    write_jobs(jobs(spark, ("old", "pending", 0, 5)).drop("attempt_count"), path)
    write_jobs(jobs(spark, ("new", "pending", 0, 5)).withColumn("attempt_count", F.lit(3)), path)
    got = {r.guid: r for r in read_jobs(spark, path).collect()}
    assert got["old"].attempt_count == 0 and got["new"].attempt_count == 3
    assert got["old"].created_at == T0 and got["old"].timings is None


def test_job_files_with_zoneless_times(spark, tmp_path):
    path = str(tmp_path / "jobs")
    ntz = jobs(spark, ("a", "pending", 3, 5)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    ntz.write.parquet(path)
    assert read_jobs(spark, path).collect()[0].created_at == at(3)


def test_status_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write_jobs(jobs(spark, ("a", "pending", 3, 5)), path)
    plan = Q.pending(read_jobs(spark, path)).select("guid")._jdf.queryExecution().toString()
    assert "EqualTo(status,pending)" in plan
    assert "ReadSchema: struct<guid:string,status:string>" in plan
