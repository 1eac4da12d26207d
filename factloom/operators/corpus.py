"""Corpus profile, identity and change: what there is, whether it is the same, and what to index anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X


def profile(docs: DataFrame, *by: str) -> DataFrame:
    """Counts of texts, characters, lines and distinct contents per group."""
    n = F.length("text")
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(n.cast("long")).alias("chars"), F.sum(F.size(X.lines(F.col("text"))).cast("long")).alias("lines"),
        F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.countDistinct(X.content_hash(F.col("text"))).alias("contents"),
    )


def files(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of facts per text: hash, characters, lines."""
    return docs.select(key, X.content_hash(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("chars"), F.size(X.lines(F.col("text"))).cast("long").alias("lines"))


def duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contents that occur more than once, how many rows are extra, and the first of them."""
    grouped = files(docs, key).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))
    return grouped.where("n > 1").select("sha256", "n", (F.col("n") - 1).alias("extras"), "first_id")


def snapshot_id(rows: DataFrame, key: str = "doc_id", digest: str = "sha256", per_bucket: int = 50_000) -> DataFrame:
    """One hash of all (key, content hash) pairs, in two levels so that no task sees every row.

    Pairs are dealt into 16**width buckets by a hash of the key, the width growing with the number of pairs so that a
    bucket has about per_bucket of them; each bucket hashes its sorted pairs, and the snapshot hashes the sorted buckets.
    Equal sets of pairs give equal ids, whatever their order or partitioning.
    """
    width = 2
    n = rows.count()
    while n > per_bucket * 16**width:
        width += 1
    pair = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest))
    dealt = rows.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, width).alias("bucket"), pair.alias("pair"))
    buckets = dealt.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("pair")), "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("n"))
    line = F.concat("bucket", F.lit(":"), "hash")
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("snapshot_id"), F.sum("n").alias("n_files"))


def diff(old: DataFrame, new: DataFrame, key: str = "doc_id", digest: str = "sha256") -> DataFrame:
    """key and status (added, removed, changed, same) of every key of two snapshots."""
    joined = old.select(key, F.col(digest).alias("old")).join(new.select(key, F.col(digest).alias("new")), key, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return joined.select(key, status.alias("status"))


def refresh(index: DataFrame, new: DataFrame, key: str = "doc_id", digest: str = "sha256") -> DataFrame:
    """The index after a refresh: rows whose content stayed, and all rows of changed or new files; origin tells which."""
    kept = index.join(new.select(key, digest), [key, digest], "left_semi").withColumn("origin", F.lit("kept"))
    return kept.unionByName(new.join(index.select(key, digest), [key, digest], "left_anti").withColumn("origin", F.lit("indexed")))


def physical_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 1) and text of every physical line."""
    return docs.select(key, F.posexplode(X.lines(F.col("text"))).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")
