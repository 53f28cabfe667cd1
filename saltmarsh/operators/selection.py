"""Values at exact places of sorted groups, and lots taken in order, without a whole group in one task.

Places are found by refining histograms: a group's values are counted between its approximate quantiles, the interval with the wanted place is cut
again, until few distinct values are left. Running sums are taken over coarse pieces first, then within a piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.sources.shared import saved

CUTS = 64  # intervals that a histogram has
FEW = 1_000_000  # rows whose distinct values one task may sort
PREFIX = 4  # leading characters of a lot's name that part a day's lots
GIFT_DAYS = 90


def index_percentile(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], offset: int = 0) -> DataFrame:
    """Values at place floor(share * n) - offset of the sorted ones, never between two; nulls don't count. Null keys are a group; NaN is the largest value."""
    values = rows.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.lit("").alias("_part"), F.col(value).alias("_v"))
    n = F.col("n")
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(share) * n) - offset)).cast("bigint").alias("place")) for name, share in shares.items()])
    wanted = saved(values.groupBy("_k", "_part").agg(F.count("*").alias("n")).select("_k", "_part", "n", n.alias("size"), F.inline(places)), "places")
    found = []
    while (wanted.agg(F.max("size")).first()[0] or 0) > FEW:
        told, values, wanted = _refined(values, wanted)
        found.append(told)
    parts = values.join(wanted.select("_k", "_part").distinct(), ["_k", "_part"], "left_semi").groupBy("_k", "_part", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_k", "_part").orderBy("_v"))  # of FEW values at most
    last = parts.withColumn("upto", upto).join(wanted, ["_k", "_part"]).filter(F.col("upto") > F.col("place"))
    found.append(last.groupBy("_k", "n", "name").agg(F.min("_v").alias("value")))
    every = reduce(DataFrame.unionByName, found)
    picked = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares]
    return every.groupBy("_k").agg(F.max("n").alias("n"), *picked).select("_k.*", "n", *shares)


def _refined(values: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One histogram: places that are found as their interval has one value, the rows of the other intervals, and the places within these."""
    at = ["_k", "_part"]
    shares = [i / CUTS for i in range(CUTS + 1)]
    # the largest value is a cut of its own, so each round parts an interval of several values
    cuts = values.groupBy(*at).agg(F.array_sort(F.array_distinct(F.array_append(F.percentile_approx("_v", shares, 10_000), F.max("_v")))).alias("cuts"))
    dealt = values.join(cuts, at).select(*at, "_v", F.size(F.filter("cuts", lambda c: c <= F.col("_v"))).alias("cut"))
    counts = dealt.groupBy(*at, "cut").agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    before = F.sum("c").over(Window.partitionBy(*at).orderBy("cut")) - F.col("c")  # of CUTS + 2 intervals
    chosen = wanted.join(counts.withColumn("before", before), at).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
    path = F.concat_ws(".", "_part", F.col("cut").cast("string"))
    chosen = saved(chosen.select("_k", path.alias("_part"), "n", F.col("c").alias("size"), "name", (F.col("place") - F.col("before")).alias("place"), "least", "most"), "places")
    left = chosen.filter("least < most").drop("least", "most")
    rows = dealt.select("_k", path.alias("_part"), "_v").join(left.select(*at).distinct(), at, "left_semi")
    return chosen.filter("least = most").select("_k", "n", "name", F.col("least").alias("value")), saved(rows, "interval"), left


def ranked_by_hash(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Add ``_place`` (from 1, by the hash of ``key``, then by key) and ``_size`` of each group: places within ranges of the hash, after the rows of the ranges before."""
    hashed = df.withColumn("_k", F.struct(*group)).withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    ranges = Window.partitionBy("_k").orderBy("_b")  # 4096 ranges at most
    before = sizes.select("_k", "_b", (F.sum("_n").over(ranges) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_k")).alias("_size"))
    place = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_h", key))
    return hashed.join(before, ["_k", "_b"]).withColumn("_place", place + F.col("_before")).drop("_k", "_h", "_b", "_before")


def allocate_fefo(lots: DataFrame, needs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Take each sku's need from its lots, the earliest expiry first, and gifts from the latest; where all lots are too few for both, nothing is taken.

    lots: sku, lot, expiry, qty; needs: sku, need and, if any, gift. Returns the lots with ``taken``, ``gift_taken``, ``enough`` and ``near_expiry``: something is taken of a
    lot that expires less than 90 days after ``as_of`` (null without it). A lot without an expiry comes last, and first for gifts. Null quantities and needs are 0; equal expiries go by the
    lot's name. Rows that repeat a lot share its place in no set order. Skus without a need aren't returned; null skus neither.

    Sums run over a sku's days, then over a day's lots by the first characters of their names, then over those lots.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = lots.withColumn("_q", zero("qty")).withColumn("_day", F.coalesce(F.col("expiry").cast("date"), F.lit("9999-12-31").cast("date"))).withColumn("_p", F.substring(F.coalesce(F.col("lot").cast("string"), F.lit("")), 1, PREFIX))
    gift = zero("gift") if "gift" in needs.columns else F.lit(0).cast("bigint")
    asked = needs.filter(F.col("sku").isNotNull()).select("sku", zero("need").alias("_need"), gift.alias("_gift"))
    cells = rows.groupBy("sku", "_day", "_p").agg(F.sum("_q").alias("_c"))
    days = cells.groupBy("sku", "_day").agg(F.sum("_c").alias("_d"))
    by_day = Window.partitionBy("sku").orderBy("_day")
    days = days.select("sku", "_day", (F.sum("_d").over(by_day) - F.col("_d")).alias("_before_day"), F.sum("_d").over(Window.partitionBy("sku")).alias("_total")).join(asked, "sku")
    by_name = Window.partitionBy("sku", "_day").orderBy("_p")
    cells = cells.select("sku", "_day", "_p", (F.sum("_c").over(by_name) - F.col("_c")).alias("_before_cell")).join(days, ["sku", "_day"])
    within = Window.partitionBy("sku", "_day", "_p").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_within", F.sum("_q").over(within) - F.col("_q")).join(cells, ["sku", "_day", "_p"])
    before = F.col("_before_day") + F.col("_before_cell") + F.col("_within")
    after = F.col("_total") - before - F.col("_q")
    enough = F.col("_total") >= F.col("_need") + F.col("_gift")
    part = lambda left: F.when(enough, F.greatest(F.lit(0), F.least(F.col("_q"), left))).otherwise(0).cast("bigint")
    rows = rows.withColumn("enough", enough).withColumn("taken", part(F.col("_need") - before)).withColumn("gift_taken", part(F.col("_gift") - after))
    soon = F.lit(None).cast("boolean") if as_of is None else (F.col("taken") + F.col("gift_taken") > 0) & (F.coalesce(F.datediff("expiry", as_of), F.lit(GIFT_DAYS)) < GIFT_DAYS)
    return rows.withColumn("near_expiry", soon).select(*lots.columns, "taken", "gift_taken", "enough", "near_expiry")
