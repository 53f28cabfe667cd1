"""Reading tables and files. Schemas are explicit where the format has none; rows that don't fit are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON lines file, and the lines that aren't such rows (blank ones are neither)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row._corrupt").isNotNull() | F.col("row").isNull()
    return parsed.filter(~bad).select("row.*").drop("_corrupt"), parsed.filter(bad).select("value")


def read_sheet(spark: SparkSession, path: str, schema: str, list_columns: tuple[str, ...] = ()) -> DataFrame:
    """A CSV sheet with a header; ``list_columns`` hold lists parted by |."""
    df = spark.read.csv(path, header=True, schema=schema)
    for name in list_columns:
        df = df.withColumn(name, F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, r"\|")))
    return df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: source (the file's name) and text."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The result of a query of a database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def new_rows(incoming: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't present yet: incremental ingest and resuming."""
    return incoming.join(present.select(key), key, "left_anti")


def overlay(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(base.columns))
