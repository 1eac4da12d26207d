"""Exact deduplication as a stateful stream.

Every row becomes an arrival (digest of the normalised text, identifier, content locator). The arrivals are a file stream,
read in several micro-batches; a keyed aggregation without watermark keeps, per digest, the largest identifier with its
locator and the number of rows. That state lives in RocksDB on the executors' disks, is checkpointed in the shared folder
and never expires, so each micro-batch meets all earlier ones. With state_path it outlives the run: a later run there
meets the arrivals of all earlier runs. Without, the state is the run's own and is removed with its end.

A hit is only a hit if the whole normalised texts agree byte for byte: the locators fetch the texts of the rows that met
another one, and no others, and they are compared. Rows whose digest agrees and whose bytes do not are regrouped by
their text itself.

Partial aggregation runs before the shuffle, so a text with a third of all rows costs one row per task. Rows that met
nobody need no join at all: the groups of several rows and the names of the hits are broadcast while they are few (their
number is checked) and joined by the optimizer's choice beyond.

Defined results: a null text is the empty text; a null identifier sorts below all others; of repeated rows
(same identifier and text) exactly one is kept, by drop_copies the first in the order of all columns; an empty table
gives an empty result; further columns of the input are ignored by find_copies and kept by drop_copies, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm.rows import locator, small, without
from factloom.storage import delete, fresh_path, materialize, release

#: ASCII case folding and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Runtime settings that the session of the stream takes over from the caller's.
TAKEN_OVER = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")
#: Memory of an executor's state stores, outside the heap: all of them share it, so it does not grow with partitions.
STORE_MEMORY = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": 96, "writeBufferSizeMB": 4, "maxWriteBufferNumber": 2}
#: Micro-batches that the arrivals of a run are read in, unless files_per_batch says otherwise.
BATCHES = 3


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the content locator of the row (a hash of its identifier and raw text) and the normalised text."""
    return docs.select(F.col(id_col).alias("id"), locator(F.col(id_col), F.col(text_col)).alias("locator"), normalised(F.col(text_col)).alias("norm"))


def _stream_state(arrivals: DataFrame, folder: str, files_per_batch: int | None) -> DataFrame:
    """Run arrivals through the keyed state in folder; one row per digest met so far: head (largest id, its locator), size."""
    spark = arrivals.sparkSession
    session = spark.newSession()
    for key in TAKEN_OVER:
        if (value := spark.conf.get(key, None)) is not None:
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each partition reserves disk it never fills
    for name, megabytes in STORE_MEMORY.items():
        session.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{name}", str(megabytes))
    files_per_batch = files_per_batch or max(1, math.ceil(len(arrivals.inputFiles()) / BATCHES))
    stream = session.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/arrivals")
    kept = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("head"), F.count(F.lit(1)).alias("size"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = kept.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    head = T.StructType([T.StructField("id", arrivals.schema["id"].dataType), T.StructField("locator", T.LongType())])
    form = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("head", head), T.StructField("size", T.LongType()), T.StructField("batch", T.IntegerType())])
    if query.lastProgress is None and not arrivals.inputFiles():
        return spark.createDataFrame([], form).drop("batch")
    updates = spark.read.schema(form).parquet(f"{folder}/updates")
    return updates.groupBy("digest").agg(F.max_by(F.struct("head", "size"), "batch").alias("last")).select("digest", "last.head", "last.size")


def find_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
    state_path: str | None = None, earlier: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: id, locator, keep_id, keep_locator, group_size, kept, digest.

    digest: binary digest of the normalised text; files_per_batch: arrivals files in one micro-batch. state_path: a folder
    in shared storage where the state of earlier runs is met and this run's is left; the same rows should not be given
    to it twice. earlier: the rows of those runs, whose texts hits are compared with; groups and sizes count them too.
    """
    spark = docs.sparkSession
    folder = state_path.rstrip("/") if state_path else fresh_path(spark, "dedup")
    rows = _identified(docs, id_col, text_col)
    path = f"{folder}/arrivals"
    before = _known(spark, path)
    rows.select("id", "locator", digest(F.col("norm")).alias("digest")).write.mode("append").parquet(path)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("locator", T.LongType()), T.StructField("digest", T.BinaryType())])
    fresh = [f for f in spark.read.schema(schema).parquet(path).inputFiles() if f not in before]
    arrivals = spark.read.schema(schema).parquet(*fresh) if fresh else spark.createDataFrame([], schema)
    met = _stream_state(arrivals, folder, files_per_batch).where("size > 1")
    met = materialize(met.select("digest", F.col("head.id").alias("head_id"), F.col("head.locator").alias("head_locator"), "size"), "dedup-met")
    if not state_path:
        delete(spark, f"{folder}/updates")
        delete(spark, f"{folder}/state")

    hits = materialize(arrivals.join(small(met), "digest").select("id", "locator", "digest", "head_id", "head_locator"), "dedup-hits")
    others = hits.where(~(F.col("id").eqNullSafe(F.col("head_id")) & (F.col("locator") == F.col("head_locator")))).select("id", "locator", "digest").distinct()
    heads = hits.select(F.col("head_id").alias("id"), F.col("head_locator").alias("locator"), "digest").distinct()
    texts = rows if earlier is None else rows.union(_identified(earlier, id_col, text_col))

    def text_of(wanted: DataFrame) -> DataFrame:
        wanted = small(wanted.withColumnRenamed("id", "wanted_id"))
        return texts.join(wanted, "locator").where(F.col("id").eqNullSafe(F.col("wanted_id"))).drop("wanted_id")

    head_text = text_of(heads).groupBy("digest").agg(F.first("norm").alias("head_norm"))
    differ = materialize(text_of(others).join(head_text, "digest").where(F.col("norm") != F.col("head_norm")).select("id", "locator", "digest", "norm").dropDuplicates(["id", "locator"]), "dedup-differ")

    alone = F.col("size").isNull()
    result = arrivals.join(small(met), "digest", "left").select(
        "id", "locator", "digest", F.when(alone, F.col("id")).otherwise(F.col("head_id")).alias("keep_id"), F.when(alone, F.col("locator")).otherwise(F.col("head_locator")).alias("keep_locator"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
    )
    if not differ.isEmpty():
        result = _regrouped(arrivals, result, differ)
    result = result.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator")))
    if not hits.groupBy("id", "locator").count().where("count > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("id", "locator").orderBy("digest"))
        result = result.withColumn("kept", F.col("kept") & (turn == 1))
    release(hits)
    return result


def _known(spark, path: str) -> set[str]:
    """The files that earlier runs left there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return set()
    return set(spark.read.schema("id string").parquet(path).inputFiles())


def _regrouped(arrivals: DataFrame, result: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows that share a digest with another text get groups of their own, by digest and whole text."""
    counted = differ.join(arrivals.groupBy(F.col("id").alias("a_id"), F.col("locator").alias("a_locator")).agg(F.count(F.lit(1)).alias("times")), F.col("id").eqNullSafe(F.col("a_id")) & (F.col("locator") == F.col("a_locator")))
    own = counted.groupBy("digest", "norm").agg(F.max(F.struct("id", "locator")).alias("own"), F.sum("times").alias("own_size"))
    moved = differ.join(own, ["digest", "norm"]).select(F.col("id").alias("m_id"), F.col("locator").alias("m_locator"), "own", "own_size")
    fewer = own.groupBy("digest").agg(F.sum("own_size").alias("gone"))
    joined = result.join(moved, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("locator") == F.col("m_locator")), "left").join(fewer, "digest", "left")
    alone = F.col("own").isNull()
    return joined.select(
        "id", "locator", "digest", F.when(alone, F.col("keep_id")).otherwise(F.col("own.id")).alias("keep_id"),
        F.when(alone, F.col("keep_locator")).otherwise(F.col("own.locator")).alias("keep_locator"),
        F.when(alone, F.col("group_size") - F.coalesce("gone", F.lit(0))).otherwise(F.col("own_size")).alias("group_size"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = materialize(find_copies(docs, id_col, text_col), "dedup-found")
    gone = materialize(found.where("not kept").select("id", "locator"), "dedup-gone")
    # repeated rows share their name with the one that is kept
    kept = found.where("kept").select("id", F.col("locator").alias("kept_locator")).withColumnRenamed("id", "kept_id")
    named = small(gone.distinct())
    repeated = materialize(kept.join(named, (F.col("kept_locator") == F.col("locator")) & F.col("kept_id").eqNullSafe(F.col("id")), "left_semi").select(F.col("kept_id").alias("id"), F.col("kept_locator").alias("locator")), "dedup-repeated")
    release(found)
    return without(docs, gone, repeated, id_col, text_col)
