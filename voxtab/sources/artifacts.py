"""The artifact folder as rows."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import file_ext
from voxtab.sources.files import list_files, own_file_name


def list_artifacts(spark: SparkSession, folder: str, in_tasks: bool = False) -> DataFrame:
    """(guid, kind, path) of the files in a folder; their content is not read.

    Spark lists the folder on the driver and keeps what it found there. With `in_tasks` a task
    lists it instead, for folders of millions of files; that needs a file system that pyarrow
    knows (local, hdfs, s3, gs, abfs)."""
    if in_tasks:
        return classify_artifacts(list_files(spark, folder).select(F.col("name").alias("path")))
    listing = spark.read.format("binaryFile").load(folder)
    return classify_artifacts(listing.select(own_file_name().alias("path")))


def classify_artifacts(names: DataFrame) -> DataFrame:
    """Kind and guid by file name; a name without a known suffix is an original."""
    path = F.col("path")
    kind, guid = F.lit(C.ARTIFACT_ORIGINAL), path
    guid = F.substr(path, F.lit(1), F.length(path) - F.length(file_ext(path)))
    for name, suffix in reversed(C.ARTIFACT_SUFFIXES):
        hit = path.endswith(suffix)
        kind = F.when(hit, name).otherwise(kind)
        stem = F.regexp_replace(path, re.escape(suffix) + r"\z", "")
        guid = F.when(hit, stem).otherwise(guid)
    return names.select(guid.alias("guid"), kind.alias("kind"), "path")
