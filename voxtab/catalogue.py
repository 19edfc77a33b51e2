"""Every operator as a query over the benchmark tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.fixtures import NOW, Inputs
from voxtab.functions.encoding import decode_timings, encode_timings
from voxtab.functions.text import (
    duration_text,
    is_garbage,
    is_valid_guid,
    remove_boundary_duplicates,
    squash_repeats,
)
from voxtab.functions.timing import processing_estimate
from voxtab.operators import admission as A
from voxtab.operators import alignment as AL
from voxtab.operators import audio as AU
from voxtab.operators import lifecycle as L
from voxtab.operators import queue as Q
from voxtab.operators import scoring as S
from voxtab.operators.ordered import collect_in_order
from voxtab.plans import selection
from voxtab.plans.batch import process_jobs
from voxtab.session import configure, cut, run_folder
from voxtab.sources import job_store
from voxtab.sources.alignment import parse_alignment
from voxtab.sources.jobs import append_jobs, conform_jobs, evolve_schema
from voxtab.streaming import lifecycle as stream_lifecycle
from voxtab.streaming import monitor
from voxtab.streaming.dedupe import dedupe_submissions
from voxtab.streaming.guard import guard_submissions
from voxtab.streaming.runner import run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs(configure(spark), sf_dir))

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return run


def now():
    return F.lit(NOW).cast("timestamp")


def full_jobs(i: Inputs) -> DataFrame:
    return conform_jobs(i.view("jobs"))


def six(name: str):
    """Six decimals. Means of short decimals often end in an exact half, which engines
    round apart; the nudge settles those and is far below the last digit kept."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


# Queue


@query
def status_report(i):
    report = Q.status_report(full_jobs(i))
    return report.withColumn("n_timings", F.size("timings")).drop("timings")


@query
def wait_ahead(i):
    return Q.wait_ahead(i.view("jobs")).select("guid", "ahead_sec")


@query
def list_jobs(i):
    return Q.list_jobs(full_jobs(i))


@query
def lookup_jobs(i):
    found = Q.lookup_jobs(i.view("jobs"), i.view("submissions"))
    return found.select("guid", "found", "status", "created_at", "processing_time_est")


@query
def status_counts(i):
    return Q.status_counts(i.view("jobs"))


@query
def in_flight_jobs(i):
    return Q.in_flight(i.view("jobs")).select("guid", "status", "created_at")


@query
def backlog(i):
    return Q.backlog(i.view("jobs"))


@query
def queue_summary(i):
    return Q.queue_summary(i.view("jobs"))


@query
def wait_texts(i):
    waiting = Q.wait_ahead(i.view("jobs"))
    return waiting.select("guid", duration_text(F.col("ahead_sec")).alias("wait"))


@query
def monitor_eta(i):
    return Q.monitor_eta(i.view("jobs"))


@query
def next_pending(i):
    return Q.next_pending(i.view("jobs"), 20).select("guid", "filename", "created_at")


@query
def estimate_check(i):
    own = processing_estimate(F.col("duration_sec")).alias("estimate_sec")
    return i.view("jobs").select("guid", own)


# Admission


@query
def admission(i):
    return A.admit(i.view("submissions"), i.view("jobs")).select("arrival", "guid", "reason")


@query
def guid_validity(i):
    guid = F.col("guid")
    return i.view("submissions").select("arrival", is_valid_guid(guid).alias("valid"))


def admitted(i: Inputs) -> DataFrame:
    checked = A.admit(i.view("submissions"), i.view("jobs"))
    return checked.where(F.col("reason") == C.ADMITTED)


@query
def admission_eta(i):
    eta = A.admission_eta(cut(admitted(i)), i.view("jobs"), now())
    return eta.select(
        "arrival", "guid", "processing_time_est", "ahead_sec", "estimated_completion_utc"
    )


@query
def append_new_jobs(i):
    own = processing_estimate(F.col("duration_sec"))
    new = admitted(i).withColumn("processing_time_est", own)
    return append_jobs(i.view("jobs"), new, now()).select(
        "guid", "filename", "status", "created_at", "processing_time_est", "attempt_count"
    )


@query
def evolve_job_schema(i):
    old = i.view("jobs").drop("attempt_count", "duration_sec")
    grown = evolve_schema(old, {"attempt_count": (0, "int")})
    return conform_jobs(grown).select(
        "guid", "filename", "status", "created_at", "completed_at",
        "processing_time_est", "attempt_count",
    )


# Lifecycle


@query
def lifecycle_fold(i):
    return L.fold_lifecycle(i.view("job_events"))


@query
def apply_outcomes(i):
    jobs = full_jobs(i)
    outcomes = L.fold_lifecycle(i.view("job_events"), initial=jobs)
    return L.apply_outcomes(jobs, outcomes).select(
        "guid", "status", "attempt_count", "completed_at", "transcription"
    )


@query
def stored_outcomes(i):
    """The outcomes written over a stored table in two batches, the second of them twice."""
    jobs = full_jobs(i)
    path = run_folder(i.spark, "jobs")
    job_store.create_store(jobs, path, buckets=16)
    outcomes = cut(L.fold_lifecycle(i.view("job_events"), initial=jobs))
    late = F.col("status") == C.COMPLETED
    for batch_id, part in ((1, outcomes.where(~late)), (2, outcomes.where(late)), (2, outcomes)):
        job_store.store_outcomes(i.spark, path, batch_id, part)
    return job_store.read_store(i.spark, path).select(
        "guid", "status", "attempt_count", "completed_at", "transcription"
    )


@query
def stored_admissions(i):
    """Admitted submissions added to a stored table, then what retention leaves of it."""
    path = run_folder(i.spark, "jobs")
    job_store.create_store(full_jobs(i), path, buckets=16)
    own = processing_estimate(F.col("duration_sec"))
    new = admitted(i).withColumn("processing_time_est", own)
    job_store.store_admitted(i.spark, path, 1, new, now())
    job_store.store_expiry(i.spark, path, 2, NOW)
    return job_store.read_store(i.spark, path).select(
        "guid", "filename", "status", "created_at", "processing_time_est", "attempt_count"
    )


@query
def recover_stuck(i):
    return L.recover_stuck(i.view("jobs")).select("guid", "status", "attempt_count")


@query
def stuck_count(i):
    return L.stuck_count(i.view("jobs"))


@query
def expire_jobs(i):
    gone, kept = L.expire(i.view("jobs"), NOW)
    parts = [df.select("guid", "status", "created_at") for df in (gone, kept)]
    return parts[0].withColumn("expired", F.lit(True)).unionByName(
        parts[1].withColumn("expired", F.lit(False))
    )


@query
def expired_artifacts(i):
    gone, _ = L.expire(i.view("jobs"), NOW)
    return L.expired_artifacts(gone)


# Text and transcripts


@query
def clean_segments(i):
    return S.clean_segments(i.view("segments")).drop("speaker")


@query
def assemble_transcript(i):
    return S.assemble_transcript(S.clean_segments(i.view("segments")))


@query
def garbage_flags(i):
    return i.table("documents").select("doc_id", is_garbage(F.col("text")).alias("garbage"))


@query
def boundary_duplicates(i):
    return i.table("documents").select(
        "doc_id", remove_boundary_duplicates(F.col("text")).alias("text")
    )


@query
def squash_repeated_words(i):
    return i.table("documents").select("doc_id", squash_repeats(F.col("text")).alias("text"))


@query
def alignment_text(i):
    return selection.alignment_text(i.view("segments"))


# Scoring


@query
def pass_fan_out(i):
    return S.fan_out_passes(i.view("jobs").select("guid"))


@query
def pass_confidence(i):
    return S.weighted_confidence(i.view("words")).select("guid", "pass_index", six("confidence"))


@query
def segment_confidence(i):
    by = ("guid", "pass_index", "seg_index")
    return S.weighted_confidence(i.view("words"), by).select(*by, six("confidence"))


def word_scores(i: Inputs) -> DataFrame:
    """Scores of passes known by their words alone."""
    words = i.view("words")
    counts = words.groupBy("guid", "pass_index").agg(F.count("*").alias("word_count"))
    scores = S.weighted_confidence(words).join(counts, ["guid", "pass_index"])
    return S.score_passes(scores.join(i.view("durations"), "guid"))


@query
def adjusted_confidence(i):
    return word_scores(i).select(
        "guid", "pass_index", "word_count", "duration_sec",
        six("wps"), six("adjusted"), "suspiciously_short",
    )


@query
def best_pass(i):
    return S.best_pass(word_scores(i)).select(
        "guid", "pass_index", six("confidence"), six("adjusted")
    )


def recognised(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    return i.view("pass_segments"), i.view("words"), i.view("durations")


@query
def best_segments(i):
    return selection.best_segments(*recognised(i)).select(
        "guid", "pass_index", "seg_index", "seg_start", "seg_end", "text"
    )


@query
def select_transcript(i):
    chosen = selection.select_transcripts(*recognised(i))
    return chosen.withColumn("n_timings", F.size("timings")).drop("timings")


# Alignment


@query
def speaker_counts(i):
    return AL.speaker_counts(i.view("jobs"), i.view("turns"), i.view("diarized"))


@query
def alignment_gate(i):
    gated = AL.gate_alignment(i.view("jobs"), i.view("turns"), i.view("diarized"))
    return gated.select("guid", "n_speakers", "refine")


@query
def jobs_to_align(i):
    aligned = i.view("aligned_words").select("guid").distinct()
    return AL.needs_alignment(i.view("jobs"), aligned).select("guid", "status")


@query
def alignment_words(i):
    """Word tiers as JSON text, one tenth of them without the tier, read back."""
    entry = F.concat(
        F.lit("["), F.col("word_start").cast("string"), F.lit(","),
        F.col("word_end").cast("string"), F.lit(","),
        F.lit('"'), F.col("word"), F.lit('"]'),
    )
    tiers = collect_in_order(i.view("aligned_words"), ["guid"], "word_index", entry, "entries")
    body = F.concat(
        F.lit('{"tiers":{"words":{"entries":['), F.array_join("entries", ","), F.lit("]}}}")
    )
    text = F.when(F.col("guid").like("%7"), F.lit('{"tiers":{}}')).otherwise(body)
    return parse_alignment(tiers.select("guid", text.alias("json")))


@query
def align_words(i):
    pairs = AL.align_words(i.view("segments"), i.view("aligned_words"))
    return pairs.select("guid", "seg_index", "word_index", "word_start", "word")


@query
def refine_segments(i):
    refined = AL.refine_segments(i.view("segments"), i.view("aligned_words"))
    return refined.select("guid", "seg_index", "text", six("refined_start"), six("refined_end"))


@query
def corrupt_flags(i):
    texts = selection.transcripts_of(S.clean_segments(i.view("segments")), deduplicate=False)
    stored = F.when(~F.col("guid").like("%5"), encode_timings(F.col("timings")))
    rows = texts.withColumn("timings", decode_timings(stored))
    corrupt = AL.is_corrupt(F.col("transcription"), F.col("timings"))
    return rows.select("guid", corrupt.alias("corrupt"))


@query
def timings_json(i):
    texts = selection.transcripts_of(S.clean_segments(i.view("segments")), deduplicate=False)
    back = decode_timings(encode_timings(F.col("timings")))
    rows = texts.select("guid", F.posexplode(back).alias("pos", "t"))
    return rows.select(
        "guid", "pos",
        F.round("t.start", 6).alias("start_sec"), F.round("t.end", 6).alias("end_sec"), "t.text",
    )


# Audio


@query
def loudness(i):
    stats = AU.needs_denoise(AU.noise_energy(i.view("frames"), full_scale=1.0))
    return stats.select(
        "guid", "n_samples", six("dbfs"), six("gain_db"), six("factor"),
        "duration_sec", six("noise_energy"), "needs_denoise",
    )


@query
def normalized_frames(i):
    frames = i.view("frames")
    scaled = AU.normalize_gain(frames, AU.loudness(frames, 1.0), 1.0)
    return scaled.select("guid", "seq", F.size("samples").alias("n"), F.round(
        F.aggregate("samples", F.lit(0.0), lambda t, x: t + F.abs(x.cast("double"))), 3
    ).alias("level"))


@query
def resolve_audio(i):
    return AU.resolve_audio(i.view("jobs"), i.view("listing")).select(
        "guid", "audio_found", "audio_path"
    )


# Whole jobs


def batch(i: Inputs, deduplicate: bool) -> DataFrame:
    done = process_jobs(
        full_jobs(i), i.view("listing"), *recognised(i),
        i.view("turns"), i.view("diarized"), i.view("aligned_words"),
        now=NOW, deduplicate=deduplicate,
    )
    last = F.element_at("timings", -1)
    first = F.element_at("timings", 1)
    return done.select(
        "guid", "status", "attempt_count", "completed_at", "transcription",
        F.size("timings").alias("n_timings"),
        F.round(first["start"], 6).alias("first_start"),
        F.round(last["end"], 6).alias("last_end"),
    )


@query
def job_batch(i):
    return batch(i, deduplicate=False)


@query
def job_batch_deduplicated(i):
    return batch(i, deduplicate=True)


# Streams, run over what the tables hold


@query
def lifecycle_stream(i):
    updates = stream_lifecycle.lifecycle_stream(i.stream_view("job_events"))
    return stream_lifecycle.latest_states(run_available(updates, "lifecycle"))


@query
def dedupe_stream(i):
    submitted = F.timestamp_micros(
        F.unix_micros(now()) + F.col("arrival") * F.lit(1_000_000).cast("bigint")
    )
    stream = i.stream_view("submissions").where(is_valid_guid(F.col("guid")))
    stream = dedupe_submissions(stream.withColumn("submitted_at", submitted))
    return run_available(stream.select("guid", "submitted_at"), "dedupe").select("guid")


@query
def guarded_stream(i):
    """Submissions against the job table, while some of its open jobs complete."""
    instant = lambda unit: F.timestamp_micros(F.unix_micros(now()) + F.col(unit) * F.lit(100_000).cast("bigint"))
    asked = i.stream_view("submissions").where(is_valid_guid(F.col("guid")))
    asked = asked.select("guid", "arrival", instant("arrival").alias("submitted_at"))
    told = i.stream_view("jobs").where(F.col("status").isin(C.PENDING, C.PROCESSING) & (F.col("processing_time_est") % 3 == 0))
    told = told.withColumn("wait", F.col("processing_time_est") % 1000)
    told = told.select("guid", F.lit(C.COMPLETED).alias("status"), instant("wait").alias("at"))
    checked = guard_submissions(asked, told, i.view("jobs"))
    return run_available(checked, "guard").select("guid", "arrival", "reason")


@query
def monitor_stream(i):
    estimates = i.view("jobs").select("guid", "processing_time_est")
    events = i.stream_view("job_events").join(estimates, "guid", "left")
    running, folder = monitor.queue_monitor_stream(events, every=None)
    running.awaitTermination()
    history = monitor.queue_history(i.spark, folder)
    return history.orderBy(F.desc("batch_id")).limit(1).drop("batch_id")
