"""Choosing carriers: hard filter, criteria, weights, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights and the values from which a criterion counts in full. Fixed values.
WEIGHTS = {"price": 0.30, "proximity": 0.20, "credit": 0.20, "reliability": 0.15, "discount": 0.10, "tenure": 0.05}
MAX_DISTANCE_KM, MAX_CREDIT_DAYS, MAX_DISCOUNT_PCT, MAX_TENURE_YEARS = 60.0, 45.0, 20.0, 10.0
EARTH_KM = 6371.0
CLOSE_CALL = 0.05


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(half))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def latest_offers(offers: DataFrame, position: str) -> DataFrame:
    """One offer a request and carrier: of several the last one wins."""
    return offers.groupBy("request_id", "carrier_id").agg(F.max_by("price", position).alias("price"))


def hard_filter(candidates: DataFrame) -> DataFrame:
    """Add ``reason`` (null: eligible): the vehicle is looked at first, then the offer; no vehicle types at all means any.

    Input: request_id, vehicle_type, carrier_id, vehicle_types (array), price (null: no offer).
    """
    misses = (F.size(F.coalesce("vehicle_types", F.array())) > 0) & ~F.array_contains("vehicle_types", F.col("vehicle_type"))
    return candidates.withColumn("reason", F.when(misses, "no such vehicle").when(F.col("price").isNull(), "no offer"))


def criteria(eligible: DataFrame) -> DataFrame:
    """One row for each criterion of each eligible carrier, 0 to 1 or null where unknown.

    Price is the request's lowest price over the carrier's, the others are shares of fixed ceilings.
    """
    lowest = F.min("price").over(Window.partitionBy("request_id"))
    price = F.when(F.col("price") <= 0, F.lit(0.0)).otherwise(lowest / F.nullif(F.col("price"), F.lit(0.0)))
    values = {
        "price": price,
        "proximity": 1 - clamp01(F.col("distance_km") / MAX_DISTANCE_KM),
        "credit": clamp01(F.col("credit_days") / MAX_CREDIT_DAYS),
        "reliability": clamp01(F.col("on_time_rate")),
        "discount": clamp01(F.col("discount_pct") / MAX_DISCOUNT_PCT),
        "tenure": clamp01(F.col("years_partner") / MAX_TENURE_YEARS),
    }
    wide = eligible.select("request_id", "carrier_id", "position", *[F.when(F.col(raw).isNotNull(), v).cast("double").alias(k) for (k, v), raw in zip(values.items(), ("price", "distance_km", "credit_days", "on_time_rate", "discount_pct", "years_partner"), strict=True)])
    return wide.unpivot(["request_id", "carrier_id", "position"], list(values), "criterion", "value")


def rank_carriers(eligible: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Score and rank the eligible carriers of each request.

    A criterion counts only where it is known for all of a request's carriers; the weights of the others are scaled to
    sum to 1. Ties of the score, rounded to 4 decimals, keep the carriers' order (``position``). ``missing`` lists what didn't
    count, ``gap`` is the lead over the next one, ``close_call`` a lead of less than 0.05. Without usable weights no rows.
    """
    weights = weights or WEIGHTS
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    group = Window.partitionBy("request_id", "criterion")
    rows = criteria(eligible).withColumn("usable", F.count("value").over(group) == F.count("*").over(group))
    rows = rows.withColumn("weight", F.when(F.col("usable"), F.coalesce(weight[F.col("criterion")], F.lit(0.0))))
    scored = rows.groupBy("request_id", "carrier_id", "position").agg(
        F.sum("weight").alias("total"),
        F.sum(F.col("weight") * F.col("value")).alias("points"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("usable"), F.col("criterion")))), ",").alias("missing"),
    )
    scored = scored.filter(F.col("total") > 0).withColumn("score", F.round(F.col("points") / F.col("total"), 4))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "position")
    gap = F.round(F.col("score") - F.lead("score").over(order), 4)
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("gap", gap)
    return ranked.select("request_id", "carrier_id", "rank", "score", "missing", "gap", (F.col("gap") < CLOSE_CALL).alias("close_call"))


def breakdown(eligible: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Why each eligible carrier scores as it does: for each criterion that counts, its value, its weight scaled as in the ranking and their product (4 decimals each), the largest first (``place``).

    Equal products keep the order of the weights. A criterion without a weight counts with 0; a request without usable weights has no rows.
    """
    weights = weights or WEIGHTS
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    known = Window.partitionBy("request_id", "criterion")
    rows = criteria(eligible).withColumn("usable", F.count("value").over(known) == F.count("*").over(known)).filter("usable")
    rows = rows.withColumn("w", F.coalesce(weight[F.col("criterion")], F.lit(0.0)))
    carrier = Window.partitionBy("request_id", "carrier_id", "position")  # six rows at most
    rows = rows.withColumn("total", F.sum("w").over(carrier)).filter(F.col("total") > 0)
    share = F.col("w") / F.col("total")
    told = rows.select("request_id", "carrier_id", "position", "criterion", F.round("value", 4).alias("normalized"), F.round(share, 4).alias("weight"), F.round(F.col("value") * share, 4).alias("contribution"))
    at = F.array_position(F.array(*map(F.lit, weights)), F.col("criterion"))
    return told.withColumn("place", F.row_number().over(carrier.orderBy(F.desc("contribution"), at))).drop("position")
