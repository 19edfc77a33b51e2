"""Transcript sink."""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.sources.files import file_system, list_files

TEXT_COLUMNS = ("transcript", "transcription", "text")


def _named(transcripts: DataFrame) -> DataFrame:
    name = next(n for n in TEXT_COLUMNS if n in transcripts.columns)
    return transcripts.select("guid", F.col(name).alias("transcript"))


def write_transcripts(
    transcripts: DataFrame, path: str, layout: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One text per guid: the column transcript, transcription or text, whichever comes first,
    written as `transcript`. `parquet` suits any number of guids; `text` makes a
    folder with one single-line text per guid, for small sets that other tools read."""
    transcripts = _named(transcripts)
    if layout == "parquet":
        transcripts.write.mode(mode).parquet(path)
    elif layout == "text":
        lines = transcripts.select("guid", F.col("transcript").alias("value"))
        lines.write.mode(mode).partitionBy("guid").text(path)
    else:
        raise ValueError(f"unknown layout {layout!r}")


def write_transcript_files(transcripts: DataFrame, folder: str) -> int:
    """Write `{guid}.txt` with the text of each guid into a folder, over files of that name, and
    return how many. Null texts are empty. Guids must differ and be file names.

    Tasks write to a folder of this run's own, so that a task that is repeated or runs twice only
    writes its files again. When all are there, tasks move them into place. If a task fails for
    good, that folder goes and nothing has been published. For a file system that pyarrow
    knows (local, hdfs, s3, gs, abfs)."""
    spark = transcripts.sparkSession
    files, _ = file_system(folder)
    staging = f"{folder.rstrip('/')}/.voxtab-{uuid.uuid4().hex}"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = file_system(staging)
        for batch in batches:
            for guid, text in zip(batch["guid"], batch["transcript"], strict=True):
                if not guid or "/" in guid or guid.startswith((".", "_")):
                    raise ValueError(f"{guid!r} cannot be a file name")
                own = f"{path}/.{guid}-{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write((text or "").encode())
                files.move(own, f"{path}/{guid}.txt")
            yield pd.DataFrame({"n": [len(batch)]})

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = file_system(staging)
        _, target = file_system(folder)
        for batch in batches:
            for name in batch["name"]:
                # Gone if this task has run before.
                if files.get_file_info(f"{path}/{name}").is_file:
                    files.move(f"{path}/{name}", f"{target}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    path = file_system(staging)[1]
    files.create_dir(path, recursive=True)
    try:
        written = _named(transcripts).mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
        names = list_files(spark, staging).select("name").repartition("name")
        moved = names.mapInPandas(publish, "n long").agg(F.sum("n")).first()[0] or 0
        if moved != written:
            raise ValueError(f"{written} texts make {moved} files: guids must differ")
        return moved
    finally:
        files.delete_dir(path)
