"""Quotes put together from sheets: the price of fuel at the time, offers that are valid, the pricing rule that fits, and approval that happens once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NUMBERS = 86_400  # a piece of a time line of numbers
DAY_BITS = 23  # of the number of days that dates span
DEFAULT_RULE = "Mặc định"  # fixed value


def price_as_of(events: DataFrame, prices: DataFrame, key: str, unit: str = "month") -> DataFrame:
    """Each event (key, ts: a time or a number, any other columns) with the latest ``price`` of its key not after it; null without any. A null key has none.

    Both sides are one time line, cut by ``unit``: a line's piece is one sort of its own, and begins with the last price of the pieces
    before, so a key with most rows is many pieces. Of prices at one time the largest counts; null prices don't.
    """
    kind = prices.schema["price"].dataType
    row = F.struct(*events.columns)
    priced = prices.filter(F.col("price").isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("_k"), F.col("ts").alias("_ts"), F.col("price").alias("_p"))
    asked = events.select(F.col(key).alias("_k"), F.col("ts").alias("_ts"), F.lit(None).cast(kind).alias("_p"), row.alias("_row"))
    none = F.lit(None).cast(asked.schema["_row"].dataType)
    of_time = isinstance(events.schema["ts"].dataType, T.DateType | T.TimestampType | T.TimestampNTZType)
    piece = F.date_trunc(unit, "_ts") if of_time else F.floor(F.col("_ts") / NUMBERS)
    line = asked.unionByName(priced.select("*", none.alias("_row"))).withColumn("_piece", piece)
    ends = line.filter(F.col("_k").isNotNull()).groupBy("_k", "_piece").agg(F.max(F.when(F.col("_row").isNull(), F.struct("_ts", "_p"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a key's pieces
    carried = ends.select("_k", "_piece", F.last("_end", ignorenulls=True).over(before)["_p"].alias("_carried"))
    within = Window.partitionBy("_k", "_piece").orderBy("_ts", F.col("_row").isNotNull(), "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = line.filter(F.col("_k").isNotNull()).withColumn("_last", F.last("_p", ignorenulls=True).over(within)).filter(F.col("_row").isNotNull())
    joined = told.join(carried, (told["_k"] == carried["_k"]) & told["_piece"].eqNullSafe(carried["_piece"]), "left")
    found = joined.select("_row.*", F.coalesce("_last", "_carried").alias("price"))
    return found.unionByName(asked.filter(F.col("_k").isNull()).select("_row.*", F.lit(None).cast(kind).alias("price")))


def valid_offers(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """(vehicle_type, day, n_offers, best): how many offers each asked vehicle has on each asked day, and the cheapest (price, carrier_id).

    requests: vehicle_type, day; offers: carrier_id, vehicle_type, price, valid_from, valid_to (dates; null: open). Offers of one vehicle and time are aggregated first, and
    no offer meets its days: its time is cut into stretches of 1, 2, 4, ... days that begin at multiples of their length, two of each length at most, which are
    aggregated, and each distinct day meets the one stretch of each length that it lies in. Offers without a price don't count; a price that repeats goes by the smaller carrier.
    """
    days = requests.select("vehicle_type", "day").dropna().distinct()
    span = days.groupBy("vehicle_type").agg(F.min("day").alias("_low"), F.max("day").alias("_high"))
    some = offers.filter(F.col("price").isNotNull() & F.col("vehicle_type").isNotNull())
    some = some.groupBy("vehicle_type", "valid_from", "valid_to").agg(F.count("*").alias("_n"), F.min(F.struct("price", "carrier_id")).alias("_best")).join(span, "vehicle_type")
    first, last = F.greatest(F.coalesce("valid_from", "_low"), "_low"), F.least(F.coalesce("valid_to", "_high"), "_high")
    met = some.withColumn("_first", F.unix_date(first)).withColumn("_end", F.unix_date(last) + 1).filter("_first < _end")
    levels = F.sequence(F.lit(0), F.lit(DAY_BITS))

    def cut(level: Column) -> Column:
        """The stretches of 2 ** level days at both ends of a time that no longer stretch covers."""
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(F.col("_first") / size), F.floor(F.col("_end") / size)
        at = lambda place, odd: F.when((a < b) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("_level"), place.alias("_at")))
        return F.array(at(a, a), at(b - 1, b))

    cuts = met.select("vehicle_type", "_n", "_best", F.inline(F.filter(F.flatten(F.transform(levels, cut)), lambda x: x.isNotNull())))
    cuts = cuts.groupBy("vehicle_type", "_level", "_at").agg(F.sum("_n").alias("_n"), F.min("_best").alias("_best"))
    lies = F.transform(levels, lambda level: F.struct(level.alias("_level"), F.floor(F.unix_date("day") / F.pow(F.lit(2.0), level)).alias("_at")))
    both = days.select("vehicle_type", "day", F.inline(lies)).join(cuts, ["vehicle_type", "_level", "_at"])
    return both.groupBy("vehicle_type", "day").agg(F.sum("_n").alias("n_offers"), F.min("_best").alias("best"))


def fitting_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule``: the row of rules (name, place, ...) of the request's cargo_type, else the default one, else the first; null where there are none.

    Of rules with one name that with the smallest place counts. ``rules`` is a sheet: three of its rows at most meet each request.
    """
    whole = F.struct(*rules.columns)
    named = rules.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min_by(whole, "place").alias("_named"))
    rest = rules.agg(F.min_by(whole, F.when(F.col("name") == DEFAULT_RULE, F.col("place"))).alias("_default"), F.min_by(whole, "place").alias("_first"), F.lit(1).alias("_one"))
    has_default = F.when(F.col("_default.name") == DEFAULT_RULE, F.col("_default"))
    joined = requests.join(F.broadcast(named), requests["cargo_type"] == named["name"], "left").drop("name").withColumn("_one", F.lit(1)).join(F.broadcast(rest), "_one", "left")  # one row
    return joined.withColumn("rule", F.coalesce("_named", has_default, "_first")).drop("_named", "_default", "_first", "_one")


def assemble(requests: DataFrame, offers: DataFrame, rules: DataFrame, fuel: DataFrame) -> DataFrame:
    """Each request (request_id, vehicle_type, cargo_type, day) with the latest diesel price, its valid offers, its rule and the cheapest carrier's quote payload, or an ``error``.

    fuel: fuel_type, date, price. Errors: a required field is missing, no rule, no offer. The payload has carrier_cost, the rule's figures
    with their defaults (sensitivity .35, floor 0, no surcharge without a name) and the fuel price, which is looked up once for each distinct day.
    """
    diesel = fuel.filter("fuel_type = 'diesel'").select("fuel_type", F.col("date").cast("timestamp_ntz").alias("ts"), "price")
    asked = requests.select("day").dropna().distinct().withColumn("fuel_type", F.lit("diesel")).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    priced = price_as_of(asked, diesel, "fuel_type").select("day", F.col("price").alias("fuel_price"))
    met = requests.join(F.broadcast(priced), "day", "left").join(valid_offers(requests, offers), ["vehicle_type", "day"], "left")
    ruled = fitting_rule(met, rules)
    error = (
        F.when(F.coalesce("vehicle_type", F.lit("")) == "", "missing: vehicle_type")
        .when(F.col("day").isNull(), "missing: day")
        .when(F.col("rule").isNull(), "no pricing rule")
        .when(F.col("best").isNull(), "no carrier fits")
    )
    r = F.col("rule")
    surcharges = F.when(r["surcharge_name"].isNotNull(), F.array(F.struct(r["surcharge_name"].alias("name"), F.coalesce(r["surcharge_amount"], F.lit(0.0)).alias("amount"), F.coalesce(r["surcharge_pct"], F.lit(0.0)).alias("pct"))))
    figures = {
        "carrier_id": F.col("best.carrier_id"),
        "carrier_cost": F.col("best.price"),
        "base_margin_pct": r["base_margin_pct"],
        "fuel_sensitivity": F.coalesce(r["fuel_sensitivity"], F.lit(0.35)),
        "fuel_baseline_price": r["fuel_baseline_price"],
        "min_margin_amount": F.coalesce(r["min_margin_amount"], F.lit(0.0)),
        "surcharges": surcharges,
        "current_fuel_price": F.col("fuel_price"),
    }
    rows = ruled.withColumn("error", error)
    kept = {k: F.when(F.col("error").isNull(), c).alias(k) for k, c in figures.items()}
    return rows.select("request_id", F.coalesce("n_offers", F.lit(0)).alias("n_offers"), r["name"].alias("rule_name"), "error", *kept.values())


def outcome(status: Column, email: Column, first: Column) -> Column:
    """What an approval does: not_found, already (the draft isn't pending any more), no_email, or sent."""
    return F.when(status.isNull(), "not_found").when((status != "pending") | ~first, "already").when(F.coalesce(F.trim(email), F.lit("")) == "", "no_email").otherwise("sent")


def approve(approvals: DataFrame, drafts: DataFrame) -> DataFrame:
    """Each approval (approval_id, draft_id, ts) with its ``outcome``: of a pending draft (draft_id, status, customer_email) the first one sends, later ones find it sent.

    Of approvals at one time the smaller id is first. A draft without an address is never sent, so each of its approvals says so. The first approval is a minimum by draft, so a
    draft with many is no task of its own.
    """
    firsts = approvals.groupBy("draft_id").agg(F.min(F.struct("ts", "approval_id")).alias("_first")).join(drafts.select("draft_id", "status", "customer_email"), "draft_id", "left")
    rows = approvals.join(firsts, "draft_id", "left")
    blank = F.coalesce(F.trim("customer_email"), F.lit("")) == ""
    first = (F.struct("ts", "approval_id") == F.col("_first")) | blank
    return rows.select(*approvals.columns, outcome(F.col("status"), F.col("customer_email"), F.coalesce(first, F.lit(False))).alias("outcome"))
