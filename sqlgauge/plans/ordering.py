"""Running sums over a position column without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def sum_before(
    df: DataFrame, keys: list[str], position: str, weight: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over rows of the same key at smaller positions (unique per key).

    Positions are cut into fixed blocks. Block totals are pre-aggregated, so the only per-key window
    runs over one row per block; the row-level window is bounded by the block width.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block))).withColumn(
        "_weight", weight.cast("long")
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    by_key = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*so_far)
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_weight").alias("_total"))
        .withColumn("_start", F.sum("_total").over(by_key) - F.col("_total"))
        .drop("_total")
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(*so_far)
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.sum("_weight").over(in_block) - F.col("_weight"))
        .drop("_block", "_weight", "_start")
    )
