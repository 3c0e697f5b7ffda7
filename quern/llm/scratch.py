"""Cutting lineage through tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a folder of its own, gone when it
    ends. On a cluster a folder of one machine would be none that executors share: that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The tables stay in that folder as checkpoints do: results that are not yet
    computed read them. Later uses read the files, so neither the input nor any Python stage runs
    again, and a lost executor takes nothing with it. ``free``: shuffle files of the write go with its
    end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
