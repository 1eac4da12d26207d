"""Retrieval metrics per query over ranked results and gold relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, gold: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """ranked (group, key, rank), gold (group, key, relevance) -> recall, precision, mrr and ndcg at k per group.

    Unjudged results count as not relevant and are counted beside; a group without gold has null recall and ndcg.
    """
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    top = ranked.where(F.col("rank") <= k).join(gold, [group, key], "left")
    found = top.groupBy(group).agg(
        F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)).alias("hits"), F.sum(F.when(F.col("relevance").isNull(), 1).otherwise(0)).alias("unjudged"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"), F.sum(F.when(F.col("relevance") > 0, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    from pyspark.sql.window import Window

    best = gold.where("relevance > 0").withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("relevance"), key)))
    ideal = best.groupBy(group).agg(F.count(F.lit(1)).alias("wanted"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"))
    joined = found.join(ideal, group, "left")
    return joined.select(
        group, F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("hits") / F.lit(k), 6).alias("precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"), "unjudged",
    )
