"""Session settings and the shared folder for checkpoints and stream output."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that results or plans rely on. Everything sized by the cluster
# (shuffle partitions, memory, cores) is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Long texts and whole audio files go to Python in bounded batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. In local mode, where one machine
    does all work, a temporary one stands in."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxtab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for one run of a stream."""
    return f"{shared_folder(spark)}/voxtab/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table behind a checkpoint in the shared folder: its lineage ends there, executors
    may be lost, and Spark removes the files when the table is no longer used."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def stream_session(spark: SparkSession, state_partitions: int | None = None):
    """Settings for starting a stateful stream. A stream keeps the number of state
    partitions it starts with: `state_partitions`, or what the session is set to."""
    settings = dict(STREAM_SETTINGS)
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
