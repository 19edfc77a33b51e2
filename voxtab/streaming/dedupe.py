"""Streaming guard against a guid submitted twice."""

from pyspark.sql import DataFrame


def dedupe_submissions(
    stream: DataFrame, horizon: str = "1 day", time: str = "submitted_at"
) -> DataFrame:
    """The first submission of each guid within the horizon. The batch check is exact;
    here a guid is free again a horizon after its submission, whatever became of it."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["guid"])
