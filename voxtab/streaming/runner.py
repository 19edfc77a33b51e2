"""Running a stream over what is there now."""

from pyspark.sql import DataFrame

from voxtab.session import run_folder, stream_session


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run an append stream over the available input and return what it wrote. The
    output and the stream's own checkpoint go below `folder`, by default a new one in
    the shared folder; the same folder again continues the stream."""
    spark = stream.sparkSession
    folder = folder or run_folder(spark, name)
    with stream_session(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
