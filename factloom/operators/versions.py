"""Append-only versions: as-of reads, upserts, intervals, pending rewrites and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(log: DataFrame, key: str, seq: str, generation: Column | None = None) -> DataFrame:
    """The latest row of each key, not later than generation. One aggregation, partial before the shuffle."""
    seen = log if generation is None else log.where(F.col(seq) <= generation)
    last = seen.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), seq).alias("row"))
    return last.select(key, "row.*").select(log.columns)


def scd2(log: DataFrame, key: str, seq: str) -> DataFrame:
    """log with valid_from and valid_to: each version holds until the key's next one; null while it is open."""
    following = F.lead(seq).over(Window.partitionBy(key).orderBy(seq))
    return log.withColumn("valid_from", F.col(seq)).withColumn("valid_to", following)


def without_pending(current: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    return current.join(pending.select(key).distinct(), key, "left_anti")


def keyset_page(rows: DataFrame, after: Column, order: list[str], limit: int) -> DataFrame:
    """The next rows after a cursor: a range filter that reaches the scan, not an offset."""
    return rows.where(after).orderBy(*order).limit(limit)


def commit(history: DataFrame, changed: DataFrame, key: str, version: int) -> DataFrame:
    """history (key, payload, start_version, end_version) after a commit: open rows of changed keys end at version, and
    changed rows (key, payload) that are new or differ open there. A commit that is run again changes nothing."""
    now = changed.select(key, F.col("payload").alias("new_payload"))
    at = history.join(now, key, "left")
    closes = F.col("end_version").isNull() & F.col("new_payload").isNotNull() & ~F.col("payload").eqNullSafe(F.col("new_payload")) & (F.col("start_version") < version)
    kept = at.select(key, "payload", "start_version", F.when(closes, F.lit(version)).otherwise(F.col("end_version")).alias("end_version"))
    standing = history.where("end_version is null").select(key, F.col("payload").alias("old"), F.col("start_version").alias("since"))
    fresh = now.join(standing, key, "left").where((F.col("since").isNull() | ~F.col("old").eqNullSafe(F.col("new_payload"))) & (F.coalesce("since", F.lit(-1)) < version))
    return kept.unionByName(fresh.select(key, F.col("new_payload").alias("payload"), F.lit(version).alias("start_version"), F.lit(None).cast("int").alias("end_version")))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many keys were added, changed and removed between two content versions."""
    joined = old.select(key, F.col(digest).alias("old")).join(new.select(key, F.col(digest).alias("new")), key, "full")
    return joined.agg(
        F.count(F.when(F.col("old").isNull(), 1)).alias("added"), F.count(F.when(F.col("old") != F.col("new"), 1)).alias("changed"), F.count(F.when(F.col("new").isNull(), 1)).alias("removed")
    )


def put(log: DataFrame, current: DataFrame, key: str = "key", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """log (kind, key, seq, data) with new rows appended, numbered after the log's last one, and the current row per key.

    current holds the new rows (kind, key, data), at most one per kind and key.
    """
    last = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("last"))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy(key))
    offset = current.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per kind
    numbered = current.withColumn("turn", turn).join(offset, "kind").crossJoin(F.broadcast(last)).withColumn(seq, F.col("last") + F.col("before") + F.col("turn"))
    longer = log.unionByName(numbered.select(*log.columns))
    newest = longer.groupBy("kind", key).agg(F.max_by(F.struct(*(c for c in log.columns if c not in ("kind", key))), seq).alias("row")).select("kind", key, "row.*").select(log.columns)
    return longer, newest


def at_version(history: DataFrame, version: int) -> DataFrame:
    """Rows of a history with start_version and end_version that hold at a version."""
    return history.where((F.col("start_version") <= version) & (F.col("end_version").isNull() | (F.col("end_version") > version)))


def search(rows: DataFrame, text: str, limit: int, after=None, key: str = "key", body: str = "payload") -> DataFrame:
    """The next rows after a key whose JSON body holds the text, whatever its case."""
    found = rows.where(F.contains(F.lower(F.col(body)), F.lit(text.lower())))
    return (found if after is None else found.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def uncertain(runs: DataFrame, requests: DataFrame, key: str = "run_id", order: str = "started") -> DataFrame:
    """Runs that have a request which was started and not finished, newest first."""
    return runs.join(requests.where("status = 'started'").select(key), key, "left_semi").orderBy(F.desc(order), key)


def cached(derivations: DataFrame, layer: str, key: str) -> DataFrame:
    """The stored derivation of one layer and key."""
    return derivations.where((F.col("layer") == layer) & (F.col("key") == key))


def accept(ledger: DataFrame, entries: DataFrame, sources: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """(ledger, refused): entries (entry_id, path, source_sha256, payload) that are bound to a known source (path, sha256)
    replace those of the same id in the ledger, under a new generation; the others are returned with the reason."""
    at = entries.join(sources.select("path", F.col("sha256").alias("now")), "path", "left")
    reason = F.when(F.col("now").isNull(), "unknown_source").when(F.col("now") != F.col("source_sha256"), "other_content").when(F.col("payload").isNull(), "empty")
    judged = at.withColumn("reason", reason)
    taken = judged.where("reason is null").groupBy("entry_id").agg(F.max(F.struct("payload", "path", "source_sha256")).alias("x")).select("entry_id", "x.path", "x.source_sha256", "x.payload", F.lit(generation).alias("generation"))
    kept = ledger.join(taken.select("entry_id"), "entry_id", "left_anti")
    return kept.unionByName(taken), judged.where("reason is not null").select("entry_id", "path", "reason")


def record(history: DataFrame, snapshot: str, counts: DataFrame) -> DataFrame:
    """history (version, snapshot_id, added, changed, removed) with the counts of changes() as its next version, unless the
    snapshot is the latest one already."""
    last = history.agg(F.max("version").alias("v"), F.max_by("snapshot_id", "version").alias("s"))
    row = counts.crossJoin(last).where(~F.col("s").eqNullSafe(F.lit(snapshot)))  # one row each
    return history.unionByName(row.select((F.coalesce("v", F.lit(0)) + 1).cast(history.schema["version"].dataType).alias("version"), F.lit(snapshot).alias("snapshot_id"), *(F.col(c).cast(history.schema[c].dataType) for c in ("added", "changed", "removed"))))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with `batch`: runs of about `size` rows in one order, by ranges, so that no task numbers them all."""
    n = rows.count()
    parts = max(1, -(-n // size))
    return rows.repartitionByRange(parts, *order).withColumn("batch", F.spark_partition_id())


def export(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines in their key order."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(folder)
