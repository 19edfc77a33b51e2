"""Running totals over a whole table, without a window over the whole table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys per block, and blocks per zone, as a power of two. For microseconds a block
# is about a second and a zone about twelve days.
BLOCK_BITS = 20


def _before(value: str, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def preceding_sums(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """For each distinct `key` (a bigint), the sum of `value` over rows with a smaller
    key. Returns (key, before).

    Rows are summed per key first, with map-side combine, so a key that holds a large
    part of all rows is one row from there on. Sums inside a block, of blocks inside a
    zone and of zones then add up. A window sees at most 2^20 keys of one block or 2^20
    blocks of one zone. The last window sees zones only: timestamps of all years from
    1 to 9999 make under 300 thousand of them, however many rows there are.
    """
    # Spark must know that keys are not null. Else it adds a null test of its own for
    # each join below, the three uses of `points` differ, and it sums them three times.
    points = (
        df.where(key.isNotNull())
        .select(F.coalesce(key, F.lit(0)).alias("key"), value.alias("value"))
        .groupBy("key")
        .agg(F.coalesce(F.sum("value"), F.lit(0)).alias("own"))
        .withColumn("block", F.shiftright("key", BLOCK_BITS))
    )
    blocks = (
        points.groupBy("block")
        .agg(F.sum("own").alias("own"))
        .withColumn("zone", F.shiftright("block", BLOCK_BITS))
    )
    zones = blocks.groupBy("zone").agg(F.sum("own").alias("own"))
    zones = zones.select(
        "zone", _before("own", Window.orderBy("zone")).alias("zone_before")
    )
    in_zone = Window.partitionBy("zone").orderBy("block")
    blocks = (
        blocks.withColumn("in_zone", _before("own", in_zone))
        .join(zones, "zone")
        .select("block", (F.col("zone_before") + F.col("in_zone")).alias("block_before"))
    )
    in_block = Window.partitionBy("block").orderBy("key")
    return (
        points.withColumn("in_block", _before("own", in_block))
        .join(blocks, "block")
        .select("key", (F.col("block_before") + F.col("in_block")).alias("before"))
    )
