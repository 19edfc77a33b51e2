"""PCM WAV files as frames."""

import io
import wave
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.schemas import FRAMES
from voxtab.sources.files import file_system, list_files, own_file_name

FRAME_SECONDS = 1.0


def _samples(raw: bytes, width: int) -> np.ndarray:
    """PCM bytes in 16-bit units."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) * 256
    if width == 2:
        return np.frombuffer(raw, "<i2").astype(np.float32)
    if width == 3:
        low = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        padded = np.pad(low, ((0, 0), (1, 0))).reshape(-1)
        return (np.frombuffer(padded.tobytes(), "<i4") / 65536).astype(np.float32)
    return (np.frombuffer(raw, "<i4") / 65536).astype(np.float32)


def _frames(guid: str, content: bytes, seconds: float) -> Iterator[dict]:
    with wave.open(io.BytesIO(content)) as wav:
        rate, channels, width = wav.getframerate(), wav.getnchannels(), wav.getsampwidth()
        step = max(1, int(rate * seconds))
        seq = 0
        while raw := wav.readframes(step):
            yield {
                "guid": guid,
                "seq": seq,
                "sample_rate": rate,
                "channels": channels,
                "samples": _samples(raw, width),
                "error": None,
            }
            seq += 1


def read_wav(
    spark: SparkSession,
    path: str,
    frame_seconds: float = FRAME_SECONDS,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Frames of all WAV files at a path or glob; the guid is the file name without its
    extension. Samples are in 16-bit units, channels interleaved. A file goes to one
    task and leaves it as frames of a second each.

    With mode PERMISSIVE a file that is no PCM WAV becomes one row with `error` set
    instead of failing the job. Empty files give no rows in either mode.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for guid, content in zip(batch["guid"], batch["content"], strict=True):
                try:
                    for frames in batched(_frames(guid, content, frame_seconds), 60):
                        yield pd.DataFrame(frames)
                except (wave.Error, EOFError, ValueError) as problem:
                    if mode == "FAILFAST":
                        raise
                    row = dict.fromkeys(FRAMES.names)
                    row |= {"guid": guid, "error": str(problem) or type(problem).__name__}
                    yield pd.DataFrame([row], dtype=object)

    guid = F.regexp_extract(own_file_name(), r"(?s)\A(.*?)(?:\.[^.]*)?\z", 1)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[wW][aA][vV]")
        .load(path)
        .select(guid.alias("guid"), "content")
    )
    return files.mapInPandas(cut, FRAMES)


# Bytes of samples that a task reads at once.
RANGE_BYTES = 64 << 20
RANGES = (
    "guid string, path string, sample_rate int, channels int, width int, offset long, "
    "n_bytes long, step_bytes long, first_seq long, error string"
)


def wav_ranges(
    spark: SparkSession,
    folder: str,
    frame_seconds: float = FRAME_SECONDS,
    mode: str = "FAILFAST",
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Where the samples of all WAV files in a folder lie, in stretches of whole frames. Tasks list
    the folder and read the headers, and nothing else of the files."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    names = [part.split()[0] for part in RANGES.split(",")]

    def ranges(guid: str, path: str, size: int) -> Iterator[tuple]:
        files, inner = file_system(path)
        with files.open_input_file(inner) as source:
            # The header ends where the samples begin.
            wav = wave.open(source)
            start = source.tell()
            rate, channels, width = wav.getframerate(), wav.getnchannels(), wav.getsampwidth()
            there = min(wav.getnframes(), (size - start) // (channels * width)) * channels * width
        step = max(1, int(rate * frame_seconds)) * channels * width
        each = max(1, range_bytes // step) * step
        for at in range(0, there, each):
            yield guid, path, rate, channels, width, start + at, min(each, there - at), step, at // step, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, name, size in zip(batch["path"], batch["name"], batch["size"], strict=True):
                guid = name.rpartition(".")[0]
                try:
                    rows += ranges(guid, path, size)
                except (wave.Error, EOFError, ValueError) as problem:
                    if mode == "FAILFAST":
                        raise
                    reason = str(problem) or type(problem).__name__
                    rows.append((guid, path, *[None] * 7, reason))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    listed = list_files(spark, folder).where(F.lower("name").endswith(".wav"))
    return listed.repartition("path").mapInPandas(run, RANGES)


def read_wav_ranges(ranges: DataFrame) -> DataFrame:
    """Frames of the stretches of `wav_ranges`: a task holds a few frames at a time."""

    def frames(r) -> Iterator[dict]:
        files, inner = file_system(r.path)
        with files.open_input_file(inner) as source:
            source.seek(int(r.offset))
            for k in range(0, int(r.n_bytes), int(r.step_bytes)):
                raw = source.read(min(int(r.step_bytes), int(r.n_bytes) - k))
                yield {
                    "guid": r.guid, "seq": int(r.first_seq) + k // int(r.step_bytes), "sample_rate": int(r.sample_rate),
                    "channels": int(r.channels), "samples": _samples(raw, int(r.width)), "error": None,
                }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                if r.error is not None:
                    row = dict.fromkeys(FRAMES.names) | {"guid": r.guid, "error": r.error}
                    yield pd.DataFrame([row], dtype=object)
                    continue
                for some in batched(frames(r), 60):
                    yield pd.DataFrame(some)

    return ranges.repartition("path", "first_seq").mapInPandas(run, FRAMES)


def read_long_wav(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The frames of `read_wav`, for the WAV files in a folder, of any length: several tasks read one
    file, each its own stretch of it. Options as in `wav_ranges`. For a file system that pyarrow
    knows (local, hdfs, s3, gs, abfs)."""
    return read_wav_ranges(wav_ranges(spark, folder, **options))
