"""The user's own recogniser as a Spark stage."""

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab import constants as C
from voxtab.operators.audio import unreadable
from voxtab.operators.scoring import fan_out_passes
from voxtab.schemas import ATTEMPTS
from voxtab.session import cut
from voxtab.sources.files import file_system


Recogniser = Callable[[pd.DataFrame], pd.DataFrame]
REQUEST = ["guid", "pass_index"]


def _failure(request: pd.DataFrame, problem: Exception) -> pd.DataFrame:
    row = dict.fromkeys(ATTEMPTS.names)
    row |= {name: request[name].iloc[0] for name in REQUEST}
    row["error"] = str(problem) or type(problem).__name__
    return pd.DataFrame([row], dtype=object)


def _attempts(recognise: Recogniser, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Requests and what came of them: the whole batch or, if that fails, one by one."""
    try:
        yield batch, recognise(batch).assign(error=None)
        return
    except Exception as problem:  # noqa: BLE001  a user's model may raise anything
        if len(batch) == 1:
            yield batch, _failure(batch, problem)
            return
    for k in range(len(batch)):
        yield from _attempts(recognise, batch.iloc[k : k + 1])


def _dealt(requests: DataFrame, tasks: int | None) -> DataFrame:
    return requests.repartition(tasks) if tasks else requests.repartition(*REQUEST)


def transcribe_batch(
    audio: DataFrame,
    make_recogniser: Callable[[], Recogniser],
    passes=C.PASSES,
    tasks: int | None = None,
) -> DataFrame:
    """Run a recogniser over (guid, audio_path), once per pass.

    A list of paths is small, while each row of it is long work: it is dealt over `tasks`
    tasks, or as many as the session shuffles to.

    `make_recogniser` is called once per task and returns a function, so a model is
    loaded once for all batches of the task. The function gets a batch of guid,
    audio_path and the pass parameters and returns rows of `schemas.RECOGNISED`:
    segments, each with its words. If it raises, the requests of the batch are tried one
    by one; one that fails again gives a row with `error` set and no segment.

    The result is kept behind a checkpoint: segments, words and failures are read from the
    same run of the model. If the run is cut short, all of it is lost; `transcribe_resumable`
    keeps what was done.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = make_recogniser()
        for batch in batches:
            for _, found in _attempts(recognise, batch):
                yield found

    requests = fan_out_passes(audio.select("guid", "audio_path"), passes)
    return cut(_dealt(requests, tasks).mapInPandas(run, ATTEMPTS))


class _Ledger:
    """Results that one task has not yet put away. A part is a file that appears whole or not at
    all; its name comes from the requests in it, so the same part again takes its place."""

    def __init__(self, folder: str, schema: pa.Schema, seconds: float):
        self.files, self.folder = file_system(folder)
        self.schema, self.seconds = schema, seconds
        self.held: list[pd.DataFrame] = []
        self.since = time.monotonic()

    def add(self, requests: pd.DataFrame, found: pd.DataFrame) -> None:
        # A row for the request itself, so that silence counts as an answer.
        marks = requests[REQUEST].assign(**dict.fromkeys(set(ATTEMPTS.names) - set(REQUEST)))
        self.held += [marks, found]
        if time.monotonic() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows = pd.concat([f.astype(object) for f in self.held], ignore_index=True)[ATTEMPTS.names]
        asked = sorted(set(zip(rows["guid"], rows["pass_index"], strict=True)))
        name = hashlib.sha256(repr(asked).encode()).hexdigest()[:40]
        rows["part"] = name
        rows = rows.where(rows.notna(), None)
        table = pa.Table.from_pylist(rows.to_dict("records"), schema=self.schema)
        self.files.create_dir(self.folder, recursive=True)
        # Spark does not see files that begin with a dot.
        with self.files.open_output_stream(f"{self.folder}/.{name}.parquet") as out:
            pq.write_table(table, out)
        self.files.move(f"{self.folder}/.{name}.parquet", f"{self.folder}/{name}.parquet")
        self.held, self.since = [], time.monotonic()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger has, one part for each request."""
    schema = T.StructType([*ATTEMPTS.fields, T.StructField("part", T.StringType())])
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    rows = spark.read.schema(schema).parquet(folder)
    parts = rows.where("seg_index is null").groupBy(*REQUEST, "part").agg((F.count("error") > 0).alias("failed"))
    # An answer without an error comes before one with it.
    first = parts.groupBy(*REQUEST).agg(F.min(F.struct("failed", "part"))["part"].alias("part"))
    return rows.join(first, [*REQUEST, "part"], "left_semi").drop("part")


def finished_requests(spark: SparkSession, folder: str) -> DataFrame:
    """(guid, pass_index) of the requests that a ledger has answers to, with `failed`."""
    marks = _stored(spark, f"{folder}/parts").where("seg_index is null")
    return marks.groupBy(*REQUEST).agg((F.count("error") > 0).alias("failed"))


def transcribe_resumable(
    audio: DataFrame,
    make_recogniser: Callable[[], Recogniser],
    folder: str,
    passes=C.PASSES,
    tasks: int | None = None,
    together: int = 1,
    save_seconds: float = 60.0,
    retry_failed: bool = False,
) -> DataFrame:
    """`transcribe_batch` with a ledger below `folder`, which all executors share.

    A task puts its answers away every `save_seconds` and at its end, whatever becomes of the job:
    a run that is cut short and repeated with the same folder asks the model only for what is
    missing, so that at most so many seconds of work a task are done twice (0: one call). The
    recogniser gets `together` requests at a time. Failed requests count as answered unless
    `retry_failed`. Requests of earlier runs with the same folder that are not asked for now are
    not in the result; a repeated request is asked once.
    """
    spark = audio.sparkSession
    parts = f"{folder}/parts"
    requests = fan_out_passes(audio.select("guid", "audio_path"), passes)
    requests = requests.dropDuplicates(REQUEST)
    done = finished_requests(spark, folder)
    if retry_failed:
        done = done.where(~F.col("failed"))
    schema = spark.createDataFrame([], ATTEMPTS).toArrow().schema.append(pa.field("part", pa.string()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise, ledger, asked = make_recogniser(), _Ledger(parts, schema, save_seconds), 0
        try:
            for batch in batches:
                for k in range(0, len(batch), together):
                    for request, found in _attempts(recognise, batch.iloc[k : k + together]):
                        asked += len(request)
                        ledger.add(request, found)
        finally:
            ledger.flush()
        yield pd.DataFrame({"asked": [asked]})

    todo = _dealt(requests.join(done, REQUEST, "left_anti"), tasks)
    todo.mapInPandas(run, "asked long").agg(F.sum("asked")).collect()
    answers = _stored(spark, parts).join(requests.select(*REQUEST), REQUEST, "left_semi")
    return answers.where("seg_index is not null or error is not null")


def segments_of(recognised: DataFrame) -> DataFrame:
    return recognised.where(F.col("error").isNull()).drop("words", "error")


def words_of(recognised: DataFrame) -> DataFrame:
    heard = recognised.where(F.col("error").isNull())
    return heard.select(
        "guid", "pass_index", "seg_index", "seg_start", "seg_end", F.explode("words").alias("w")
    ).select("guid", "pass_index", "seg_index", "seg_start", "seg_end", "w.*")


def failed_of(recognised: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Guids with a failed request, and those of recordings in `frames` that could not be
    read: the `failed` of `plans.batch`."""
    failed = recognised.where(F.col("error").isNotNull()).select("guid")
    if frames is not None:
        failed = failed.unionByName(unreadable(frames).select("guid"))
    return failed.distinct()
