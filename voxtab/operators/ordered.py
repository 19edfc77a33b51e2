"""Ordered lists per key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BITS = 12


def collect_in_order(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str
) -> DataFrame:
    """One array of `value` per key, by ascending `order`.

    A long group is sorted in chunks of 4096 positions by many tasks; the task that
    owns the key only strings the finished chunks together.
    """
    chunks = (
        df.select(*keys, order, value.alias("value"))
        .withColumn("chunk", F.shiftright(F.col(order).cast("bigint"), CHUNK_BITS))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(order, "value"))).alias("items"))
        .select(*keys, F.struct("chunk", F.col("items.value").alias("values")).alias("c"))
    )
    whole = F.flatten(F.array_sort(F.collect_list("c")).getField("values"))
    return chunks.groupBy(*keys).agg(whole.alias(out))
