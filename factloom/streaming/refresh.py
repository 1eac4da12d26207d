"""Incremental index refresh from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import index


def refresh_index(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, key: str = "doc_id") -> None:
    """Bring the index at path up to date with all files under source that are new since the checkpoint.

    Rows are (key, text[, version][, deleted]). Each micro-batch becomes the segment of its number, and one that is run
    again overwrites itself. Of several versions of a key in one batch the greatest counts (by `version`, else by text);
    a later batch takes over from earlier ones, also where the new text has no terms; rows with `deleted` remove their
    key. Null texts are texts without terms; an empty batch writes an empty segment.
    """

    def save(batch: DataFrame, number: int) -> None:
        removed = None
        if "deleted" in batch.columns:
            order = F.struct(*(F.col(c) for c in ("version", "text") if c in batch.columns))
            last = batch.groupBy(key).agg(F.max_by("deleted", order).alias("deleted"))
            removed = last.where("deleted").select(key)
            batch = batch.join(removed, key, "left_anti").drop("deleted")
        index.refresh(batch, path, key, removed, number)

    query = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
