import pytest

import __spark_entry__ as entry
from voxtab.session import run_folder, shared_folder


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "guid", "status", "transcription", "message", "estimated_completion_utc", "error", "n_timings",
    ]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert run_folder(spark, "x") != run_folder(spark, "x")


class Elsewhere:
    """A session of a cluster that names no folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://somewhere"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
