"""Shared working storage: where intermediate tables go so that every executor can read them again.

All intermediates of an application lie in one folder below spark.checkpoint.dir. An operator releases what nothing
reads any more; what a returned DataFrame still reads stays until cleanup(), which a job calls when it has its results.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder that the cluster names.

    Where none is named, a local master (one machine, as in tests) gets a temporary folder; a cluster has no folder that
    all executors can read then, so that is an error.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs one read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def release(*written: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more; other DataFrames are left alone."""
    for df in written:
        if df is not None and (path := df.__dict__.get("scratch_path")):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Remove every intermediate table of this application."""
    delete(spark, work_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
