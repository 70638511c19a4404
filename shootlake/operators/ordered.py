"""Ordered scans and rank picks that never put one whole key into one task.

A plain window over a project sorts that project in a single task, which is right while every key is
small. Past that, a key is cut into chunks of consecutive sequence numbers, each chunk is scanned on
its own, and one summary row per chunk carries the state forward, so a key holding a third of all rows
is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
DEFAULT_WIDTH = 1 << 20


def with_chunk(df: DataFrame, seq: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """`seq` is an integer, unique within its key, so a chunk holds at most `width` rows of one key."""
    return df.withColumn(CHUNK, F.floor(F.col(seq) / F.lit(width)).cast("long"))


def pick_rank(df: DataFrame, keys: list[str], value: str, rank: Column, bins: int = 1024,
              lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """The exact value at 0-based `rank` (an expression over the group's row count `n`) per group.

    Pass one counts coarse bins, which combine map-side; pass two counts the distinct values of the
    single bin that holds the rank. Equal values collapse before the shuffle, so clipped pixels that
    repeat millions of times cost one row. Values outside [lo, hi] fall into the end bins.
    """
    step = (hi - lo) / bins
    binned = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).withColumn(
        "_bin", F.least(F.greatest(F.floor((F.col("_v") - lo) / step), F.lit(0)), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_cnt"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    target = (counts.withColumn("n", F.sum("_cnt").over(whole))
              .withColumn("_below", F.sum("_cnt").over(by_bin) - F.col("_cnt"))
              .withColumn("_rank", rank.cast("long"))
              .where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_cnt")))
              .select(*keys, "_bin", "n", "_below", "_rank"))
    values = binned.join(target, [*keys, "_bin"]).groupBy(*keys, "n", "_below", "_rank", "_v").agg(
        F.count(F.lit(1)).alias("_m"))
    by_value = Window.partitionBy(*keys).orderBy("_v")
    return (values.withColumn("_upto", F.col("_below") + F.sum("_m").over(by_value))
            .where((F.col("_upto") - F.col("_m") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
            .select(*keys, F.col("_v").alias("picked"), "n"))
