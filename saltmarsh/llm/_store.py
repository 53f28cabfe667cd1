"""Shared storage for intermediate tables.

Lineage is cut with tables written under the folder the cluster names in
``spark.checkpoint.dir``, which the driver and every executor share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER = "saltmarsh.local.folder"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_FOLDER, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="saltmarsh-")
    spark.conf.set(_LOCAL_FOLDER, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """Return an unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that its lineage ends there.

    The shuffle files of the write are deleted with it instead of when the driver next collects garbage. With ``batch_bytes``, its
    Python functions get Arrow batches of that size, as Spark and Python hold some of them at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {_CLEAN: spark.conf.get(_CLEAN, "false"), _BATCH: spark.conf.get(_BATCH)}
    spark.conf.set(_CLEAN, "true")
    if batch_bytes:
        spark.conf.set(_BATCH, batch_bytes)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` made and that no later step reads."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
