"""The job table as a stored table that batches write over.

Rows lie in folders by hash of guid. A batch writes new versions of the buckets that it touches and
then, in one small file, the list of the versions that count from there on. Readers take the newest
list, so they see all of a batch or nothing of it, and files of untouched buckets stay as they are.

    rows/batch=B/bucket=K    rows of bucket K as of batch B
    commits/batch=B          bucket, version, n_rows: for each bucket the batch that wrote it last

A batch that failed before its list was written left rows that nobody reads; the same batch id
again writes over them. A batch that is listed already changes nothing. One writer at a time.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.operators.lifecycle import apply_outcomes, expire
from voxtab.schemas import JOBS
from voxtab.session import cut
from voxtab.sources.jobs import append_jobs, conform_jobs

MANIFEST = "bucket int, version bigint, n_rows bigint"
BUCKETS = 64


def bucket_of(guid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(guid), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, batch bigint").parquet(f"{path}/commits")


def _manifest(spark: SparkSession, path: str, as_of: int | None = None) -> tuple[int, list[Row]]:
    """The newest batch, up to `as_of`, and its list: as many rows as there are buckets."""
    commits = _commits(spark, path)
    if as_of is not None:
        commits = commits.where(F.col("batch") <= as_of)
    newest = commits.agg(F.max("batch")).first()[0]
    if newest is None:
        raise ValueError(f"no stored jobs in {path}" + (f" up to batch {as_of}" if as_of is not None else ""))
    return newest, commits.where(F.col("batch") == newest).drop("batch").collect()


def _rows(spark: SparkSession, path: str, versions: list[Row]) -> DataFrame:
    """Only the folders that count are listed and read."""
    folders = [f"{path}/rows/batch={v.version}/bucket={v.bucket}" for v in versions if v.n_rows]
    if not folders:
        return spark.createDataFrame([], JOBS)
    return spark.read.schema(JOBS).parquet(*folders)


def _write(jobs: DataFrame, path: str, batch_id: int, buckets: int) -> dict[int, int]:
    """Write rows of one batch; rows by bucket. Buckets are split where they are large and go
    together where they are small, as the cluster's settings have it."""
    folder = f"{path}/rows/batch={batch_id}"
    placed = conform_jobs(jobs).withColumn("bucket", bucket_of(F.col("guid"), buckets))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    placed_schema = T.StructType([*JOBS.fields, T.StructField("bucket", T.IntegerType())])
    written = jobs.sparkSession.read.schema(placed_schema).parquet(folder)
    return {r.bucket: r["count"] for r in written.groupBy("bucket").count().collect()}


def _commit(spark: SparkSession, path: str, batch_id: int, versions: list[tuple]) -> None:
    rows = spark.createDataFrame(versions, MANIFEST).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def create_store(jobs: DataFrame, path: str, buckets: int = BUCKETS, batch_id: int = 0) -> None:
    """A new store from a job table with one row per guid. `buckets` stays as it is; with one of
    some hundred megabytes a batch of few jobs rewrites little."""
    counts = _write(jobs, path, batch_id, buckets)
    _commit(jobs.sparkSession, path, batch_id, [(b, batch_id, counts.get(b, 0)) for b in range(buckets)])


def read_store(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The job table as the newest batch left it, or as batch `as_of` did."""
    return _rows(spark, path, _manifest(spark, path, as_of)[1])


def lookup_store(spark: SparkSession, path: str, guids: list[str]) -> DataFrame:
    """The jobs of a few guids, from their buckets only."""
    _, versions = _manifest(spark, path)
    asked = spark.createDataFrame([(g,) for g in guids], "guid string")
    wanted = asked.select(bucket_of(F.col("guid"), len(versions)).alias("b")).distinct().collect()
    wanted = {r.b for r in wanted}
    return _rows(spark, path, [v for v in versions if v.bucket in wanted]).where(F.col("guid").isin(guids))


def is_stored(spark: SparkSession, path: str, batch_id: int) -> bool:
    return _commits(spark, path).where(F.col("batch") == batch_id).limit(1).count() > 0


def store_change(
    spark: SparkSession,
    path: str,
    batch_id: int,
    change: Callable[[DataFrame], DataFrame],
    guids: DataFrame | None = None,
) -> bool:
    """Write over the jobs in the buckets of `guids` (all, if None) what `change` makes of them.

    `change` gets whole buckets, with other jobs too, and must leave those as they are. Batch
    ids grow; False if this one is stored already."""
    if is_stored(spark, path, batch_id):
        return False
    newest, versions = _manifest(spark, path)
    if batch_id < newest:
        raise ValueError(f"batch {batch_id} comes after batch {newest}")
    buckets = len(versions)
    touched = {v.bucket for v in versions}
    if guids is not None:
        # As many rows as there are buckets at most.
        listed = guids.select(bucket_of(F.col("guid"), buckets).alias("bucket")).distinct().collect()
        touched = {r.bucket for r in listed}
    counts = {}
    if touched:
        old = _rows(spark, path, [v for v in versions if v.bucket in touched])
        counts = _write(change(old), path, batch_id, buckets)
        strays = set(counts) - touched
        if strays:
            raise ValueError(f"the change made jobs of other buckets: {sorted(strays)[:5]}")
    _commit(spark, path, batch_id, [
        (v.bucket, batch_id, counts.get(v.bucket, 0)) if v.bucket in touched else tuple(v) for v in versions
    ])
    return True


def store_outcomes(spark: SparkSession, path: str, batch_id: int, outcomes: DataFrame) -> bool:
    """Write outcomes (see `apply_outcomes`) over the stored jobs. Outcomes of guids that the
    store does not know change nothing."""
    outcomes = cut(outcomes)
    return store_change(spark, path, batch_id, lambda jobs: apply_outcomes(jobs, outcomes), outcomes)


def store_admitted(spark: SparkSession, path: str, batch_id: int, admitted: DataFrame, now) -> bool:
    """Add a pending job per admitted submission."""
    admitted = cut(admitted)
    return store_change(spark, path, batch_id, lambda jobs: append_jobs(jobs, admitted, now), admitted)


def store_expiry(spark: SparkSession, path: str, batch_id: int, now) -> bool:
    """Drop the jobs that retention lets go. Only buckets that hold such a job are rewritten."""
    gone = cut(expire(read_store(spark, path), now)[0].select("guid"))
    return store_change(spark, path, batch_id, lambda jobs: jobs.join(gone, "guid", "left_anti"), gone)


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """The folders (bucket, version, path) that the newest batch does not need any more; nothing is
    deleted here. Readers of older batches still use them."""
    newest, _ = _manifest(spark, path)
    ever = _commits(spark, path).where("n_rows > 0").select("bucket", "version", "batch")
    return (
        ever.groupBy("bucket", "version").agg(F.max("batch").alias("last")).where(F.col("last") < newest)
        .select("bucket", "version", F.format_string("rows/batch=%d/bucket=%d", "version", "bucket").alias("path"))
    )
