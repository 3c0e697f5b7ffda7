"""Reading the tables of a folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below the one named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets one of its own, gone when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern/{uuid.uuid4().hex}"


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` over all cores where its files give work to under half of them.

    A small table is one file and one task, whatever is computed from its texts. Larger inputs have
    more splits than the cluster has cores and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *key) if 2 * rows.rdd.getNumPartitions() <= cores else rows


#: Tables of texts and the key they are spread by.
TEXT_KEYS = {"documents": ("doc_id",), "chunks": ("id",), "web_pages": ("page_id",), "pdf_pages": ("pdf", "page"), "chat_messages": ("id",)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder, as its files are laid out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are to be worked on: all cores take part."""
    return spread(read_table(spark, sf_dir, name), *TEXT_KEYS[name])
