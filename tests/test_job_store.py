"""The stored job table: write-back, repeats, cut-short batches, versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_jobs import NOW, world  # noqa: F401

from voxtab.operators.lifecycle import apply_outcomes
from voxtab.plans.batch import process_jobs, process_store
from voxtab.sources import job_store as S
from voxtab.sources.jobs import conform_jobs

OUTCOME = "guid string, status string, attempt_count int, completed_at timestamp, cleared boolean, transcription string"


def some_jobs(spark, n=200):
    return conform_jobs(spark.range(n).select(
        F.format_string("g%d", "id").alias("guid"), F.lit("a.mp3").alias("filename"), F.lit("pending").alias("status"),
        F.lit("old text").alias("transcription"), F.lit(NOW).alias("created_at"), F.lit(50).alias("processing_time_est"),
    ))


def outcomes(spark, *guids, status="completed"):
    rows = [(g, status, 0, NOW, False, f"said {g}") for g in guids]
    return spark.createDataFrame(rows, OUTCOME)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(df) -> set[str]:
    return {f.split("/rows/")[1] for f in df.inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    S.create_store(some_jobs(spark), path, buckets=16)
    return path


def test_equals_the_table_written_over(spark, store):
    done = outcomes(spark, "g1", "g77", "unknown")
    assert S.store_outcomes(spark, store, 1, done)
    assert rows(S.read_store(spark, store)) == rows(apply_outcomes(some_jobs(spark), done))
    assert rows(S.read_store(spark, store, as_of=0)) == rows(some_jobs(spark))
    found = S.lookup_store(spark, store, ["g77", "nobody"])
    assert [(r.guid, r.transcription) for r in found.collect()] == [("g77", "said g77")]
    assert len(files(found)) <= 2


def test_same_batch_again_changes_nothing(spark, store):
    assert S.store_outcomes(spark, store, 5, outcomes(spark, "g1"))
    before = S.read_store(spark, store)
    kept = rows(before), files(before)
    assert not S.store_outcomes(spark, store, 5, outcomes(spark, "g2", status="error"))
    after = S.read_store(spark, store)
    assert (rows(after), files(after)) == kept
    with pytest.raises(ValueError, match="comes after"):
        S.store_outcomes(spark, store, 4, outcomes(spark, "g3"))


def test_untouched_buckets_keep_their_files(spark, store):
    before = files(S.read_store(spark, store))
    S.store_outcomes(spark, store, 1, outcomes(spark, "g1"))
    after = files(S.read_store(spark, store))
    assert {f.split("/")[1] for f in before - after} == {f.split("/")[1] for f in after - before}
    assert len(after - before) == 1 and len(before & after) == len(before) - 1
    old = S.superseded(spark, store).collect()
    assert {r.path for r in old} == {"rows/" + "/".join(f.split("/")[:2]) for f in before - after}


def test_a_batch_cut_short_is_not_seen(spark, store):
    def breaks(jobs):
        fail = F.raise_error(F.lit("no disk left"))
        return jobs.withColumn("status", F.when(F.col("guid") == "g1", fail).otherwise("error"))

    before = rows(S.read_store(spark, store))
    with pytest.raises(Exception, match="no disk left"):
        S.store_change(spark, store, 1, breaks)
    assert rows(S.read_store(spark, store)) == before
    # Rows of a batch that failed after they were written, too.
    S._write(some_jobs(spark, 3).withColumn("status", F.lit("error")), store, 1, 16)
    assert rows(S.read_store(spark, store)) == before
    S.store_outcomes(spark, store, 1, outcomes(spark, "g1"))
    assert rows(S.read_store(spark, store)) == rows(apply_outcomes(some_jobs(spark), outcomes(spark, "g1")))


def test_a_change_stays_in_its_buckets(spark, store):
    with pytest.raises(ValueError, match="other buckets"):
        S.store_change(spark, store, 1, lambda jobs: some_jobs(spark), outcomes(spark, "g1"))
    assert rows(S.read_store(spark, store)) == rows(some_jobs(spark))


def test_admission_and_expiry(spark, store):
    new = spark.createDataFrame([("x1", "b.wav", 70), ("x2", "c.wav", 90)], "guid string, filename string, processing_time_est bigint")
    S.store_admitted(spark, store, 1, new, NOW)
    S.store_outcomes(spark, store, 2, outcomes(spark, "g1", "x1"))
    S.store_expiry(spark, store, 3, NOW + dt.timedelta(days=2))
    left = {r.guid for r in S.read_store(spark, store).collect()}
    assert left == {f"g{k}" for k in range(200)} - {"g1"} | {"x2"}


def test_empty_store_and_no_outcomes(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(Exception):  # noqa: B017  Spark's own for a folder that is not there
        S.read_store(spark, path)
    S.create_store(some_jobs(spark, 0), path, buckets=4)
    assert S.read_store(spark, path).collect() == []
    assert S.store_outcomes(spark, path, 1, outcomes(spark, "g1"))
    assert S.store_outcomes(spark, path, 2, outcomes(spark))
    assert S.read_store(spark, path).collect() == []


def test_whole_batches(spark, tmp_path, world):  # noqa: F811
    names = ("listing", "segments", "words", "durations", "turns", "diarized", "aligned")
    inputs = [world[n] for n in names]
    path = str(tmp_path / "jobs")
    S.create_store(world["jobs"], path, buckets=4)
    seen = []
    for batch_id in (1, 2, 2, 3):
        process_store(spark, path, batch_id, *inputs, now=NOW)
        bad = {r.guid: r for r in S.read_store(spark, path).collect()}["bad"]
        seen.append((bad.status, bad.attempt_count))
        if batch_id == 1:
            assert rows(S.read_store(spark, path)) == rows(process_jobs(world["jobs"], *inputs, now=NOW))
    assert seen == [("pending", 1), ("pending", 2), ("pending", 2), ("quarantined", 3)]
