"""The job table: fixed schema, additive evolution, appends."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import PENDING
from voxtab.functions.encoding import decode_timings, encode_timings
from voxtab.schemas import JOB_DEFAULTS, JOBS


def evolve_schema(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default value; columns that exist stay as they
    are. A default is a Python value or a (value, type) pair."""
    for name, default in defaults.items():
        if name not in df.columns:
            value, kind = default if isinstance(default, tuple) else (default, None)
            column = F.lit(value)
            df = df.withColumn(name, column.cast(kind) if kind is not None else column)
    return df


def conform_jobs(df: DataFrame) -> DataFrame:
    """Any table with some of the job columns as a full job table.

    A numeric column that only some files hold is null for the others and takes its
    default. Timings stored as JSON text are decoded. The other columns stay bare, so
    filters on them reach the files.
    """
    wanted = {f.name: (JOB_DEFAULTS.get(f.name), f.dataType) for f in JOBS.fields}
    df = evolve_schema(df, wanted)
    if isinstance(df.schema["timings"].dataType, T.StringType):
        df = df.withColumn("timings", decode_timings(F.col("timings")))
    columns = []
    for field in JOBS.fields:
        column = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.IntegralType):
            default = F.lit(JOB_DEFAULTS[field.name]).cast(field.dataType)
            column = F.coalesce(column, default)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def read_jobs(spark: SparkSession, path: str, json_timings: bool = False) -> DataFrame:
    """Job files of any age, with the columns they lack filled in. With `json_timings` the
    files hold timings as JSON text."""
    kinds = {"timings": T.StringType()} if json_timings else {}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in JOBS.fields]
    return conform_jobs(spark.read.schema(T.StructType(fields)).parquet(path))


def append_jobs(jobs: DataFrame, admitted: DataFrame, now) -> DataFrame:
    """The job table with one pending row more per admitted submission."""
    new = admitted.select(
        "guid",
        "filename",
        F.lit(PENDING).alias("status"),
        F.lit(now).cast("timestamp").alias("created_at"),
        F.col("processing_time_est").cast("bigint").alias("processing_time_est"),
        F.lit(0).alias("attempt_count"),
    )
    return jobs.unionByName(new, allowMissingColumns=True)


def write_jobs(
    jobs: DataFrame, path: str, mode: str = "append", json_timings: bool = False
) -> None:
    if json_timings:
        jobs = jobs.withColumn("timings", encode_timings(F.col("timings")))
    jobs.write.mode(mode).parquet(path)
