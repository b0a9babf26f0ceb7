"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on; all can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bounded batches: rows here may carry whole documents or vectors.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Before it runs, a plan knows only compressed files, which may hold a hundred times their size in rows;
    # what is not tiny is broadcast only once its rows have been measured in a shuffle.
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # The buckets of a store are written side by side; else a task sorts its rows by bucket first.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


def build_session(app: str = "factloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings above; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut tables: the cluster's checkpoint folder, else a local one.

    A machine-local folder is only chosen where the cluster names none, as in
    tests; on a cluster ``spark.checkpoint.dir`` must point at shared storage.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to shared storage")
        configured = os.path.join(tempfile.mkdtemp(prefix="spark-factloom-", dir="/tmp"), "ckpt")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Survives the loss of executors and keeps columns prunable. The optimizer sees
    compressed bytes, which may be far fewer than the rows take in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before costly text work.

    Only a table of fewer splits than cores is redistributed; a large one
    already has many splits and is read where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
