"""Interval joins by buckets, and gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals [l_start, l_end] and [r_start, r_end] of one key that share a point.

    Each interval is listed under every bucket of `width` points that it touches, the join is an equi-join on key and
    bucket, and a pair counts only in the first bucket that both touch, so it comes once.
    """
    spread = lambda d, a, b: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    joined = spread(left, "l_start", "l_end").join(spread(right, "r_start", "r_end"), [key, "bucket"])
    first = F.floor(F.greatest("l_start", "r_start") / width) == F.col("bucket")
    return joined.where(first & (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))).drop("bucket")


def islands(rows: DataFrame, key: str, order: Column, gap: Column, tie: str) -> DataFrame:
    """rows with `island`: a new one starts where gap (a predicate over the previous row) holds."""
    node = Window.partitionBy(key).orderBy(order, tie)
    return rows.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(node.rowsBetween(Window.unboundedPreceding, 0)))
