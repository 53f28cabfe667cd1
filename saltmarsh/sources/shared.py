"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names, which the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN = "saltmarsh.shared.folder"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder; a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="saltmarsh-")
        spark.conf.set(_OWN, named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there and it is computed once.

    With ``clean``, the shuffle files of the write are deleted with it instead of when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true" if clean else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the machine at the end of a task, as the Python worker goes on with other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
