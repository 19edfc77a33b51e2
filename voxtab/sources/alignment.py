"""Aligner output: JSON text to word rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.sources.files import own_file_name

SHAPE = "tiers struct<words: struct<entries: array<array<string>>>>"


def parse_alignment(files: DataFrame, text: str = "json") -> DataFrame:
    """Word rows (guid, word_index, word_start, word_end, word) from rows of guid and
    JSON text. Text that is not JSON, lacks the word tier, or holds an entry without
    three items or a numeric start gives no rows: its guid has no alignment."""
    entries = F.from_json(F.col(text), SHAPE)["tiers"]["words"]["entries"]
    numeric = lambda e: F.get(e, F.lit(0)).try_cast("double").isNotNull()
    usable = F.forall("entries", lambda e: (F.size(e) >= 3) & numeric(e))
    rows = (
        files.select("guid", entries.alias("entries"))
        .where(usable)
        .select("guid", F.posexplode("entries").alias("pos", "e"))
    )
    number = lambda i: F.get("e", F.lit(i)).try_cast("double")
    return rows.select(
        "guid",
        (F.col("pos") + 1).cast("int").alias("word_index"),
        number(0).alias("word_start"),
        number(1).alias("word_end"),
        F.get("e", F.lit(2)).alias("word"),
    )


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of all aligner files `{guid}.json` below a path or glob."""
    guid: Column = F.regexp_extract(own_file_name(), r"\A(.*)\.json\z", 1)
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
    )
    return parse_alignment(files.select(guid.alias("guid"), F.col("value").alias("json")))
