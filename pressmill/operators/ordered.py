"""Operators over ordered paragraphs: carry forward, running totals, look-ahead.

A document may be arbitrarily long, so each operator works on blocks of consecutive
positions: block summaries are combined per document, then rows are handled per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.operators.keyed import join_on

BLOCK = 1 << 16


def _blocked(df: DataFrame, index: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(index) / block))


def carry_forward(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row."""
    rows = _blocked(df.withColumn("_v", value), index, block)
    groups = [*keys, "_blk"]
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    last_of_block = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(index)))
    summaries = (
        rows.groupBy(*groups).agg(last_of_block.alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    inside = Window.partitionBy(*groups).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_on(rows, summaries, groups, "inner")
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_v", "_blk", "_carry")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` from the start of the key up to and including each row."""
    rows = _blocked(df.withColumn("_v", value), index, block)
    groups = [*keys, "_blk"]
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    summaries = (
        rows.groupBy(*groups).agg(F.sum("_v").alias("_sum"))
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*groups).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_on(rows, summaries, groups, "inner")
        .withColumn(out, F.sum("_v").over(inside) + F.col("_carry"))
        .drop("_v", "_blk", "_carry")
    )


def look_ahead(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, n: int, out: str, block: int = BLOCK
) -> DataFrame:
    """Array of ``value`` for the rows at positions index+1 .. index+n.

    The first ``n`` positions of a block are copied to the block before it, so every
    row finds what follows it inside its own block.
    """
    own = F.floor(F.col(index) / block)
    homes = F.when(F.col(index) % block < n, F.array(own, own - 1)).otherwise(F.array(own))
    rows = df.withColumn("_v", value).withColumn("_blk", F.explode(homes))
    following = Window.partitionBy(*keys, "_blk").orderBy(index).rangeBetween(1, n)
    return (
        rows.withColumn(out, F.collect_list("_v").over(following))
        .where(F.col("_blk") == own)
        .drop("_v", "_blk")
    )
