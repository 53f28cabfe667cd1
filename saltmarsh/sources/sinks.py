"""Writing results: append, idempotent append, and a gate before anything is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from saltmarsh.sources.tables import new_rows


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key isn't in the table yet; a run that is repeated adds nothing."""
    new_rows(df, spark.read.schema(df.schema).parquet(path), key).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def gated(df: DataFrame, bad: Column, write: Callable[[DataFrame], None]) -> None:
    """Write ``df`` only if no row is bad; else nothing is written."""
    if df.filter(bad).take(1):
        raise ValueError("nothing written: some rows fail the gate")
    write(df)
