"""Spark session and durable-storage helpers.

The library never invents a machine-local folder: lineage is cut in the
shared folder the cluster names in ``spark.checkpoint.dir``.  Only tests and
the local bench set one themselves, and only when the session has none.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("shortlist")
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir is not None:
        ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of this session, or None."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint folder; set ``fallback`` only if none is set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or fallback
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set: no shared folder to write to")
    return os.path.join(base, f"shortlist-{name}-{uuid.uuid4().hex}")


def materialize_if_possible(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once when the session names a shared checkpoint folder.

    Without one, ``df`` is persisted (memory, spilling to disk) instead: still
    computed once and still an optimizer boundary, so later filters are not
    pushed back into the expensive plan below; lineage is kept, so blocks
    lost with an executor are recomputed.
    """
    if checkpoint_dir(df.sparkSession):
        return materialize(df, name)
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Survives executor loss (the files are on shared storage, unlike cached
    blocks), cuts the lineage, and lets later jobs prune columns and push
    filters into the scan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
