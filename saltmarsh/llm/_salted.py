"""Values of a group, or of a lookup table, for each row, also where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOLD = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
_FIRST = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def with_group_values(
    df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], spread_by: list[str], salts: int = 512
) -> DataFrame:
    """Add to each row what its group (equal, not null ``keys``) has as min, max, sum or count.

    ``values`` has (kind, column) by the new column's name. Rows of a group are spread over up to
    ``salts`` pieces by the hash of ``spread_by``: they are aggregated by piece, then by group, and
    each piece gets the group's values back. No task holds a whole group, and the lookup side has as
    many rows as there are pieces with rows, so never more than ``df``. Rows with a null key get nulls.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    parts = salted.dropna(subset=keys).groupBy(*keys, "_salt").agg(*[_FIRST[kind](col).alias(name) for name, (kind, col) in values.items()])
    whole = parts.groupBy(*keys).agg(*[_FOLD[kind](name).alias(name) for name, (kind, _) in values.items()], F.collect_set("_salt").alias("_salts"))
    lookup = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(lookup, [*keys, "_salt"], "left").drop("_salt")


def salted_lookup(df: DataFrame, lookup: DataFrame, key: str, spread_by: list[str], salts: int = 512) -> DataFrame:
    """Left join with ``lookup`` (one row a key), where a key of ``df`` may hold a large part of its rows.

    The lookup row of a key goes to each (key, salt) piece of ``df`` that has rows, so no task holds a whole key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    pieces = salted.select(key, "_salt").dropna().distinct()
    return salted.join(pieces.join(lookup, key), [key, "_salt"], "left").drop("_salt")
