"""Whole jobs: the retry path, missing audio, failing recogniser, gate, user recogniser."""

import datetime as dt
import os
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxtab.plans.batch import process_jobs
from voxtab.plans.transcribe import (
    failed_of,
    finished_requests,
    segments_of,
    transcribe_batch,
    transcribe_resumable,
    words_of,
)
from voxtab.schemas import RECOGNISED
from voxtab.sources.jobs import conform_jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = dt.datetime(2026, 1, 2)
GOOD = "a sentence with a good deal more than fifty letters and digits in it, said once"
JOB = "guid string, filename string, status string, created_at timestamp, processing_time_est bigint, attempt_count int"


def recogniser():
    """A stand-in that knows what each recording says."""
    says = {"good": GOOD, "again": GOOD, "talk": GOOD, "bad": "uh"}

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in batch.itertuples():
            text = says.get(r.guid, "")
            if not text or r.pass_index == 4:
                continue
            words = [
                {"word_index": k, "word_start": k * 0.2, "word_end": k * 0.2 + 0.2, "probability": 0.5 + r.pass_index / 10}
                for k, _ in enumerate(text.split())
            ]
            rows.append(
                {"guid": r.guid, "pass_index": r.pass_index, "seg_index": 0, "seg_start": 0.0, "seg_end": 2.5, "text": f" {text} ", "words": words}
            )
        return pd.DataFrame(rows, columns=RECOGNISED.names)

    return run


@pytest.fixture
def world(spark):
    guids = ["good", "again", "talk", "bad", "worse", "gone", "boom"]
    jobs = [(g, "talk.mp3", "pending", NOW, 50, 2 if g in ("again", "worse") else 0) for g in guids]
    jobs.append(("done", "talk.mp3", "completed", NOW, 50, 0))
    jobs = conform_jobs(spark.createDataFrame(jobs, JOB))
    listing = spark.createDataFrame([(g, "original") for g in guids if g != "gone"], "guid string, kind string")
    audio = jobs.select("guid", F.concat("guid", F.lit(".mp3")).alias("audio_path"))
    said = transcribe_batch(audio, recogniser)
    empty = lambda schema: spark.createDataFrame([], schema)
    return {
        "jobs": jobs,
        "listing": listing,
        "segments": segments_of(said),
        "words": words_of(said),
        "durations": spark.createDataFrame([(g, 5.0) for g in guids], "guid string, duration_sec double"),
        "turns": spark.createDataFrame([("talk", s) for s in "ab"], "guid string, speaker string"),
        "diarized": spark.createDataFrame([("talk", True)], "guid string, diarized boolean"),
        "aligned": spark.createDataFrame(
            [(g, k, 0.25 + k, 0.75 + k, "w") for g in ("good", "talk") for k in range(3)],
            "guid string, word_index int, word_start double, word_end double, word string",
        ),
        "none": empty("guid string"),
    }


def run(world, **options):
    names = ("jobs", "listing", "segments", "words", "durations", "turns", "diarized", "aligned")
    inputs = [world[n] for n in names]
    return {r.guid: r for r in process_jobs(*inputs, now=NOW, **options).collect()}


def test_outcomes(spark, world):
    failed = spark.createDataFrame([("boom",)], "guid string")
    got = run(world, failed=failed)
    state = {g: (r.status, r.attempt_count) for g, r in got.items()}
    assert state == {
        "good": ("completed", 0), "again": ("completed", 0), "talk": ("completed", 0), "bad": ("pending", 1),
        "worse": ("quarantined", 3), "gone": ("error", 0), "boom": ("error", 0), "done": ("completed", 0),
    }
    assert got["good"].transcription == GOOD
    assert tuple(got["good"].timings[0]) == (0.25, 2.75, GOOD)
    assert tuple(got["talk"].timings[0]) == (0.0, 2.5, GOOD)  # two speakers: not refined
    assert tuple(got["again"].timings[0]) == (0.0, 2.5, GOOD)  # nothing aligned
    assert got["bad"].completed_at is None
    assert got["worse"].completed_at == got["gone"].completed_at == NOW
    assert got["done"].completed_at is None


def test_garbage_requeues_then_quarantines(spark, world):
    seen = []
    for _ in range(3):
        rows = run(world)
        seen.append((rows["bad"].status, rows["bad"].attempt_count))
        world["jobs"] = spark.createDataFrame(list(rows.values()), world["jobs"].schema)
    assert seen == [("pending", 1), ("pending", 2), ("quarantined", 3)]


def test_recogniser_sees_every_pass(spark, world):
    passes = world["segments"].groupBy("guid").agg(F.sort_array(F.collect_set("pass_index")).alias("p"))
    assert {r.guid: r.p for r in passes.collect()} == {g: [0, 1, 2, 3] for g in ("good", "again", "talk", "bad")}
    assert world["words"].where("guid = 'bad'").count() == 4


def counting(folder, stop_at=None):
    """A recogniser that notes each request it is asked, and at one of them ends its process."""

    def make():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            for r in batch.itertuples():
                name = f"{r.guid}-{r.pass_index}"
                if name == stop_at:
                    os._exit(1)
                with open(f"{folder}/{name}", "a") as f:
                    f.write("x")
                if r.guid == "boom":
                    raise ValueError("cannot hear it")
            return recogniser()(batch)

        return run

    return make


def asked(folder) -> dict[str, int]:
    return {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}


def test_a_run_cut_short_goes_on_where_it_was(spark, world, tmp_path):
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    guids = ["good", "again", "talk", "bad", "worse", "gone"]
    audio = spark.createDataFrame([(g, f"{g}.mp3") for g in guids], "guid string, audio_path string")
    with pytest.raises(Exception):  # noqa: B017  Spark's own for a lost worker
        transcribe_resumable(audio, counting(notes, "talk-3"), ledger, tasks=1, save_seconds=0)
    first = asked(notes)
    assert 0 < len(first) < 30 and "talk-3" not in first
    kept = finished_requests(spark, ledger).count()
    assert kept == len(first)
    said = transcribe_resumable(audio, counting(notes), ledger, tasks=2, save_seconds=0)
    assert asked(notes) == {f"{g}-{p}": 1 for g in guids for p in range(5)}
    whole = transcribe_batch(audio, recogniser)
    assert sorted(map(str, said.collect())) == sorted(map(str, whole.collect()))
    assert words_of(said).count() == words_of(whole).count()
    # Once more: nothing is asked, and fewer recordings give fewer rows.
    again = transcribe_resumable(audio.where("guid = 'good'"), counting(notes), ledger)
    assert asked(notes) == {f"{g}-{p}": 1 for g in guids for p in range(5)}
    assert {r.guid for r in again.collect()} == {"good"}


def test_failed_requests_can_be_asked_again(spark, tmp_path):
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    audio = spark.createDataFrame([("boom", "a"), ("good", "b"), ("good", "b")], "guid string, audio_path string")
    for _ in range(2):
        said = transcribe_resumable(audio, counting(notes), ledger, together=3)
        assert [r.guid for r in failed_of(said).collect()] == ["boom"]
        assert {v for k, v in asked(notes).items() if k.startswith("good")} <= {1, 2}
    before = asked(notes)
    said = transcribe_resumable(audio, recogniser, ledger, retry_failed=True)
    assert failed_of(said).count() == 0 and asked(notes) == before
    assert segments_of(said).where("guid = 'good'").count() == 4
