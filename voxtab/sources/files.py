"""Files and folders from within tasks, by name, where Spark has no reader or writer for them."""

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.session import cut

LISTED = "path string, name string, size long, is_folder boolean"
ROWS = 10_000


def file_system(folder: str) -> tuple[FileSystem, str]:
    """A folder as Spark names it, for Python in a task. Fixed value: Spark's scheme for S3."""
    files, path = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    return files, path.rstrip("/")


def own_file_name() -> Column:
    """The name of the file that a row comes from. Spark gives it as part of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _children(folder: str) -> Iterator[pd.DataFrame]:
    files, path = file_system(folder)
    found = files.get_file_info(FileSelector(path, recursive=False, allow_not_found=True))
    # Paths keep the form in which the folder was given.
    given = folder.rstrip("/")
    written = quote if "://" in given else str
    for k in range(0, len(found), ROWS):
        rows = [
            (f"{given}/{written(i.base_name)}", i.base_name, i.size if i.size is not None else 0, i.type == FileType.Directory)
            for i in found[k : k + ROWS]
        ]
        yield pd.DataFrame(rows, columns=["path", "name", "size", "is_folder"])


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name, size) of the files in a folder, listed by tasks: nothing about the files reaches
    the driver. Names that begin with a dot or an underscore are left out, as Spark does. With
    `recursive` the folders of each level are listed side by side; the driver only counts levels.
    A folder that is not there has no files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _children(path)

    def level(folders: DataFrame) -> DataFrame:
        return folders.select("path").mapInPandas(run, LISTED).where(~F.col("name").rlike(r"\A[._]"))

    found = level(spark.createDataFrame([(folder,)], "path string").repartition(1))
    if not recursive:
        return found.where(~F.col("is_folder")).drop("is_folder")
    everything, open_folders = None, None
    while True:
        found = cut(found)
        files = found.where(~F.col("is_folder")).drop("is_folder")
        everything = files if everything is None else everything.unionByName(files)
        open_folders = found.where("is_folder")
        if open_folders.isEmpty():
            return everything
        found = level(open_folders.repartition("path"))
