"""Nested inputs of unknown shape: orders of several channels as one schema, redaction at any depth, checks of rows and their items, and quarantine."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions.text import FORBIDDEN_KEYS, SECRETS

HIDDEN, SECRET = "[ĐÃ ẨN]", "[SECRET]"  # fixed values
MAX_MESSAGE = 500  # characters of an error that are kept
#: Where each channel has what. Fixed values.
CHANNELS = {
    "shopee": {"prefix": "SHOPEE-", "id": "order_sn", "items": "item_list", "sku": "item_sku", "name": "item_name", "qty": "model_quantity_purchased", "price": "model_discounted_price"},
    "tiktok": {"prefix": "TIKTOK-", "id": "order_id", "items": "line_items", "sku": "seller_sku", "name": "product_name", "qty": "quantity", "price": "sale_price"},
    "web": {"prefix": "WOO-", "id": "id", "items": "line_items", "sku": "sku", "name": "name", "qty": "quantity", "price": "price"},
}


# ---- orders of several channels ----------------------------------------------------------------------------


def _text(v: Column, path: str) -> Column:
    """A value at a path as text; null for none, and for an empty text."""
    return F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _amount(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(text, r"^\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def _items(v: Column, fields: dict[str, str]) -> Column:
    def item(x: Column) -> Column:
        sku = _text(x, fields["sku"])
        qty = F.try_variant_get(x, f"$.{fields['qty']}", "long")
        return F.struct(
            sku.alias("sku"),
            F.coalesce(_text(x, fields["name"]), sku).alias("name"),
            F.coalesce(F.nullif(qty, F.lit(0).cast("long")), F.lit(1)).alias("qty"),
            F.coalesce(_amount(_text(x, fields["price"])), F.lit(0.0)).alias("price"),
        )

    return F.transform(F.try_variant_get(v, f"$.{fields['items']}", "array<variant>"), item)


def normalised_orders(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders of one schema (key, channel, external_id, customer, is_gift, items) from payloads (key, payload: JSON text) of three channels, and those that are none (key, error, payload).

    A quantity that is missing or 0 is 1, a missing price 0, a missing name the sku; prices may be texts. Errors: not JSON (null too), a channel that isn't known, no order id, no items.
    Payloads are parsed once; each path is read where its channel has it. What is parsed and what is read goes through an array of one element, so that the
    filters on the error stand behind it; they would otherwise be pushed down to the payloads, each with the making and parsing of a payload in it.
    """
    rows = payloads.select("key", "payload", F.explode(F.array(F.try_parse_json("payload"))).alias("v")).withColumn("channel", F.lower(F.coalesce(_text(F.col("v"), "channel"), F.lit(""))))
    external, items = F.lit(None).cast("string"), None
    for channel, fields in CHANNELS.items():
        own = F.col("channel") == channel
        external = F.when(own, F.concat(F.lit(fields["prefix"]), _text(F.col("v"), fields["id"]))).otherwise(external)
        found = _items(F.col("v"), fields)
        items = F.when(own, found).otherwise(items) if items is not None else F.when(own, found)
    person = F.nullif(F.trim(F.concat_ws(" ", _text(F.col("v"), "billing.first_name"), F.when(_text(F.col("v"), "billing.first_name").isNotNull(), _text(F.col("v"), "billing.last_name")))), F.lit(""))
    customer = F.when(F.col("channel") == "web", person).otherwise(_text(F.col("v"), "recipient_address.name"))
    gift = F.coalesce(F.try_variant_get("v", "$.is_gift", "boolean") & (F.schema_of_variant(F.try_variant_get("v", "$.is_gift", "variant")) == "BOOLEAN"), F.lit(False))
    rows = rows.select("key", "payload", "v", "channel", external.alias("external_id"), customer.alias("customer"), gift.alias("is_gift"), items.alias("items"))
    error = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(~F.col("channel").isin(*CHANNELS), F.concat(F.lit("unknown channel: "), "channel"))
        .when(F.col("external_id").isNull(), "no order id")
        .when(F.coalesce(F.size("items"), F.lit(0)) < 1, "no items")
    )
    told = rows.withColumn("error", error).drop("v")
    told = told.select(F.inline(F.array(F.struct(*told.columns))))
    return told.filter("error IS NULL").select("key", "channel", "external_id", "customer", "is_gift", "items"), told.filter("error IS NOT NULL").select("key", "error", "payload")


# ---- redaction ---------------------------------------------------------------------------------------------

_secret = re.compile("|".join(SECRETS))
_forbidden = frozenset(FORBIDDEN_KEYS)


def _redacted(value):
    if isinstance(value, dict):
        return {k: HIDDEN if k in _forbidden else _redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    return _secret.sub(SECRET, value) if isinstance(value, str) else value


def _redacted_text(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.StringType())
def redact_json(column: pa.Array) -> pa.Array:
    """JSON text without the values of forbidden keys and without secrets in any text, at any depth; null for what isn't JSON."""
    return pa.array(map(_redacted_text, column.to_pylist()), pa.string())


def redacted(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``column`` redacted, and those whose ``column`` isn't JSON (null too), as they are; these must not be logged."""
    told = rows.withColumn("_safe", redact_json(F.col(column)))
    return told.filter("_safe IS NOT NULL").withColumn(column, F.col("_safe")).drop("_safe"), told.filter("_safe IS NULL").drop("_safe")


# ---- checks ------------------------------------------------------------------------------------------------


def row_issues(constraints: list[tuple[str, Column]]) -> Column:
    """The messages of all constraints that a row breaks, in order. A condition that is unknown isn't broken."""
    broken = [F.when(~F.coalesce(good, F.lit(True)), F.lit(message)) for message, good in constraints]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def item_issues(items: str, constraints) -> Column:
    """The same for each item of an array, with its place (from 0) before the message. ``constraints`` gives (message, condition) for an item."""

    def one(item: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"{items}["), i.cast("string"), F.lit("]: "))
        return F.filter(F.array(*[F.when(~F.coalesce(good, F.lit(True)), F.concat(place, F.lit(message))) for message, good in constraints(item)]), lambda x: x.isNotNull())

    return F.coalesce(F.flatten(F.transform(items, one)), F.array().cast("array<string>"))


def invoice_issues() -> Column:
    """What breaks an invoice's schema. items: array of (name, price, qty, ...), total: a price and a total must be there, price >= 0, qty >= 1 where given, total > 0, items given."""
    rows = row_issues([("items: missing", F.col("items").isNotNull()), ("total: missing", F.col("total").isNotNull()), ("total must be > 0", F.col("total") > 0)])
    return F.concat(rows, item_issues("items", lambda x: [("price: missing", x["price"].isNotNull()), ("price must be >= 0", x["price"] >= 0), ("qty must be >= 1", x["qty"] >= 1)]))


def scan_issues() -> Column:
    """Whether a scanned invoice (overall_confidence, items: quantity, unit_price, confidence) is worth a second look at all: nothing else is said of one without items."""
    none = F.coalesce(F.size("items"), F.lit(0)) < 1
    low = row_issues([("overall confidence too low", F.coalesce("overall_confidence", F.lit(0.0)) >= 0.5)])
    lines = item_issues("items", lambda x: [("no quantity or unit price", x["quantity"].isNotNull() & x["unit_price"].isNotNull()), ("confidence too low", F.coalesce(x["confidence"], F.lit(0.0)) >= 0.4)])
    return F.when(none, F.array(F.lit("no items"))).otherwise(F.concat(low, lines))


def confidence_issues() -> Column:
    """A confidence that is known must be between 0 and 1."""
    return row_issues([("confidence must be between 0 and 1", F.col("confidence").between(0.0, 1.0))])


def quarantined(rows: DataFrame, issues: Column, path: str, name: str = "checked") -> dict[str, int]:
    """Write rows in one pass to ``path``/outcome=good and ``path``/outcome=bad (with ``issues`` and ``error``, these cut to 500 characters); returns the counts, taken on the way."""
    seen = Observation(name)
    told = rows.withColumn("issues", issues).withColumn("outcome", F.when(F.size("issues") == 0, "good").otherwise("bad"))
    told = told.withColumn("error", F.when(F.col("outcome") == "bad", F.substring(F.array_join("issues", "; "), 1, MAX_MESSAGE)))
    told = told.observe(seen, F.count_if(F.col("outcome") == "good").alias("good"), F.count_if(F.col("outcome") == "bad").alias("bad"))
    told.write.partitionBy("outcome").mode("append").parquet(path)
    return dict(seen.get)


def scanned_invoices(invoices: DataFrame, totals: DataFrame) -> DataFrame:
    """The outcome of each scanned invoice (key, items, total): ``schema_invalid`` with its issues, ``review`` where the recomputed total differs, else ``ok``.

    totals: key, is_valid, the verdict of the recomputation; a sound invoice without one goes to review. Broken and differing are outcomes of their own: what breaks the schema isn't recomputed.
    """
    told = invoices.select("key", invoice_issues().alias("issues")).join(totals.select("key", "is_valid"), "key", "left")
    outcome = F.when(F.size("issues") > 0, "schema_invalid").when(F.coalesce("is_valid", F.lit(False)), "ok").otherwise("review")
    return told.select("key", outcome.alias("outcome"), F.array_join("issues", "; ").alias("issues"))
