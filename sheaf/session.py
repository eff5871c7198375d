"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partition count is left to the
# cluster (AQE coalesces small partitions at run time); local runs pass one.
_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # month keys and ISO strings are computed in UTC
    "spark.sql.session.timeZone": "UTC",
    # joins on (doc_id, id) and a later groupBy(doc_id) may share one
    # hash partitioning instead of shuffling twice
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no broadcast from plan-time estimates (compressed Parquet sizes
    # understate rows many times); AQE broadcasts only sides whose
    # measured shuffle output is below the adaptive threshold
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "sheaf", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if is_local(master):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "12g")
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and lineage-cutting tables.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder
    and is used as is; unset there, this raises, since a folder of one machine
    would give partial tables.  Only a local master gets a scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sheaf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def is_local(master: str) -> bool:
    """One JVM on this machine (``local-cluster`` is a cluster)."""
    return master == "local" or master.startswith("local[")


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint
    folder and read it back.  Later stages scan the written table (column
    pruning and filter pushdown apply) and survive executor loss without
    recomputing the lineage.  The shuffle files of the write go when it has
    ended: nothing reads them again, and their driver-side cleaning may come
    only after the job."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # a write keeps the settings it starts with
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    return spark.read.parquet(path)


def spread(df, key: str = "doc_id"):
    """Hash-spread a CPU-heavy input over at least the default parallelism
    when its scan yields fewer partitions (e.g. one large row group).  A
    no-op for inputs that already have many splits, as at cluster scale."""
    sc = df.sparkSession.sparkContext
    n = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for a written table."""
    return os.path.join(checkpoint_dir(spark), name)
