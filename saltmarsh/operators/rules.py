"""Event and workflow rules: intake, debts, lots, stock, payments and workflow graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.text import guard_sql
from saltmarsh.operators.corpus import keep_first


def validated(events: DataFrame, required: list[str]) -> DataFrame:
    """Add ``missing``: the required fields that are null or blank, by comma; empty if none."""
    blank = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]
    return events.withColumn("missing", F.concat_ws(",", *blank))


def idempotent(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first event of each key."""
    return keep_first(events, F.struct(*key), order)


def recent_payments(events: DataFrame, as_of: str | None = None, minutes: int = 10) -> DataFrame:
    """Incoming amounts of the last minutes before ``as_of``, or before the latest event."""
    one = F.lit(1).alias("_one")
    now = events.agg(F.coalesce(F.lit(as_of).cast("timestamp_ntz"), F.max("ts")).alias("_now"), one)  # one row
    late = F.col("ts").between(F.col("_now") - F.expr(f"INTERVAL {minutes} MINUTES"), F.col("_now"))
    return events.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one").filter((F.col("amount_in") > 0) & late).drop("_one", "_now")


def overdue(debts: DataFrame, as_of: str) -> DataFrame:
    """Open or partly paid debts past their date, with what remains and the days; the longest first."""
    remaining = F.col("amount") - F.coalesce("paid_amount", F.lit(0))
    rows = debts.withColumn("remaining", remaining).withColumn("days_late", F.datediff(F.to_date(F.lit(as_of)), "due_date"))
    return rows.filter(F.col("status").isin("open", "partial") & (F.col("days_late") > 0) & (F.col("remaining") > 0)).orderBy(F.desc("days_late"))


def low_stock(stock: DataFrame) -> DataFrame:
    """Products below their own threshold."""
    return stock.filter(F.col("stock") < F.col("threshold"))


def above_rivals(own: DataFrame, rivals: DataFrame, key: str, ratio: float = 1.1) -> DataFrame:
    """Products that cost more than ``ratio`` times a rival's price."""
    return own.join(rivals, key).filter(F.col("price") > F.col("rival_price") * ratio)


def match_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments with their order by reference: matched only at exactly its amount, else for review."""
    rows = payments.join(orders, "reference", "left")
    state = F.when(F.col("order_amount").isNull(), "unknown_reference").when(F.col("amount") == F.col("order_amount"), "matched").otherwise("review")
    return rows.withColumn("state", state)


def material_window(start: Column, now: Column, hours: int = 24, urgent: int = 6) -> Column:
    """ok, urgent (under ``urgent`` hours left) or overdue, of material that has ``hours`` hours."""
    left = F.lit(hours) - (F.unix_timestamp(now) - F.unix_timestamp(start)) / 3600
    return F.when(left < 0, "overdue").when(left < urgent, "urgent").otherwise("ok")


def to_buy(bom: DataFrame, plan: DataFrame, stock: DataFrame) -> DataFrame:
    """Need, stock and what to buy of each material. bom: product, material, per_unit; plan: product, units; stock: material, on_hand."""
    need = bom.join(plan, "product").groupBy("material").agg(F.sum(F.col("per_unit") * F.col("units")).alias("need"))
    rows = need.join(stock, "material", "left").withColumn("on_hand", F.coalesce("on_hand", F.lit(0)))
    return rows.withColumn("to_buy", F.greatest(F.lit(0), F.col("need") - F.col("on_hand")))


def grouped_profit(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue, cost and profit by every prefix of the keys (rollup)."""
    rows = sales.rollup(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.grouping_id().alias("level"))
    return rows.withColumn("profit", F.col("revenue") - F.col("cost"))


def validate_workflows(workflows: DataFrame, catalog: DataFrame, blocked: list[str]) -> DataFrame:
    """First fault of each workflow, null if sound.

    workflows: id, name, nodes (array of name, type, typeVersion, position, statement), edges (array of src, dest). catalog: type,
    is_trigger. In order: no name, no nodes, a node without a name, a repeated name, a blocked or an unknown type, no version, a bad position, a
    statement that writes, not one trigger, an edge to nowhere, nodes without an edge.
    """
    n = workflows.select("id", F.posexplode_outer("nodes").alias("pos", "node"))
    n = n.select("id", "pos", "node.*").join(catalog, "type", "left")
    names = F.count("name").over(Window.partitionBy("id", "name"))
    bad = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "node without a name")
        .when(names > 1, "repeated name")
        .when(F.col("type").isin(blocked), "blocked type")
        .when(F.col("is_trigger").isNull(), "unknown type")
        .when(F.col("typeVersion").isNull(), "no version")
        .when(F.coalesce(F.size("position"), F.lit(0)) != 2, "bad position")
        .when(guard_sql(F.col("statement")).isNotNull(), "statement isn't read-only")
    )
    nodes = n.withColumn("bad", F.when(F.col("pos").isNotNull(), bad)).groupBy("id").agg(
        F.count("pos").alias("n"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("pos"))).alias("bad"), F.count_if("is_trigger").alias("triggers"), F.collect_set("name").alias("names")
    )
    ends = F.array_distinct(F.flatten(F.transform(F.coalesce("edges", F.array().cast(workflows.schema["edges"].dataType)), lambda e: F.array(e["src"], e["dest"]))))
    rows = workflows.select("id", F.col("name").alias("title"), ends.alias("ends")).join(nodes, "id", "left")
    fault = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no name")
        .when(F.coalesce("n", F.lit(0)) == 0, "no nodes")
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("triggers") != 1, "not one trigger")
        .when((F.col("n") > 1) & (F.size("ends") == 0), "no edges")
        .when(F.size(F.array_except("ends", "names")) > 0, "edge to nowhere")
        .when((F.col("n") > 1) & (F.size(F.array_except("names", "ends")) > 0), "node without an edge")
    )
    return rows.select("id", fault.alias("fault"))


def harvest_catalog(nodes: DataFrame) -> DataFrame:
    """The largest version of each type, the first row where several have it. nodes: type, version, position."""
    best = nodes.groupBy("type").agg(F.max_by(F.struct("version", "position"), F.struct("version", -F.col("position"))).alias("b"))
    return best.select("type", "b.version", "b.position")


def example_workflows(workflows: DataFrame, blocked: list[str], limit: int = 2, size: tuple[int, int] = (3, 7)) -> DataFrame:
    """The ``limit`` workflows (id, nodes: array of name, type) that serve best as examples: of 3 to 7 nodes, the fewest blocked ones first, then the smallest, then by id. Blocked nodes become ``noOp``; ``patched`` counts them."""
    n = F.size("nodes")
    bad = lambda x: F.coalesce(x["type"].isin(blocked), F.lit(False))
    rows = workflows.filter(n.between(*size)).select("id", F.size(F.filter("nodes", bad)).alias("patched"), n.alias("size"), F.transform("nodes", lambda x: x.withField("type", F.when(bad(x), "noOp").otherwise(x["type"]))).alias("nodes"))
    return rows.orderBy("patched", "size", "id").limit(limit)
