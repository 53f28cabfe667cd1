"""Queries of the event and workflow rules, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.money import money
from saltmarsh.functions.text import missing_fields
from saltmarsh.operators import carriers, demand, quotes, rules, selection, sessions, tracing
from saltmarsh.sources.tables import new_rows, overlay, table

AS_OF = "2001-06-15"


def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    debts = table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        F.round(money(F.col("o_totalprice"))).cast("long").alias("amount"),
        F.when(k % 3 > 0, F.round(money(F.col("o_totalprice")) * (k % 3) / 2).cast("long")).alias("paid_amount"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "partial").otherwise("closed").alias("status"),
    )
    return rules.overdue(debts, AS_OF).select("id", "remaining", F.col("days_late").cast("long").alias("days_late"))


OVERDUE_SQL = f"""WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE + 30 AS due, round(o_totalprice::DECIMAL(18,2))::BIGINT AS amount,
    CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice::DECIMAL(18,2)::DOUBLE * (o_orderkey % 3) / 2)::BIGINT ELSE 0 END AS paid FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT id, amount - paid AS remaining, date_diff('day', due, DATE '{AS_OF}') AS days_late FROM d WHERE amount > paid AND due < DATE '{AS_OF}'"""


def fefo(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    lots = l.select(F.col("l_partkey").alias("sku"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("lot"), F.to_date("l_shipdate").alias("expiry"), F.col("l_quantity").cast("long").alias("qty"))
    needs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), (F.col("p_size") * 20).alias("need"), F.length("p_name").alias("gift"))
    return selection.allocate_fefo(lots, needs, F.to_date(F.lit(AS_OF))).select("sku", "lot", "taken", "gift_taken", "enough", "near_expiry")


FEFO_SQL = f"""WITH l AS (SELECT l_partkey AS sku, l_orderkey || '-' || l_linenumber AS lot, l_shipdate::DATE AS expiry, l_quantity::BIGINT AS qty, p_size * 20 AS need, length(p_name) AS gift FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY sku ORDER BY expiry, lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(qty) OVER (PARTITION BY sku ORDER BY expiry DESC, lot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after, sum(qty) OVER (PARTITION BY sku) >= need + gift AS enough FROM l),
t AS (SELECT *, (CASE WHEN enough THEN greatest(0, least(qty, need - before)) ELSE 0 END)::BIGINT AS taken, (CASE WHEN enough THEN greatest(0, least(qty, gift - after)) ELSE 0 END)::BIGINT AS gift_taken FROM b)
SELECT sku, lot, taken, gift_taken, enough, taken + gift_taken > 0 AND expiry < DATE '{AS_OF}' + 90 AS near_expiry FROM t"""


def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return rules.idempotent(events, ["user_id", "event_type", "day"], "event_id").select("event_id")


IDEMPOTENT_SQL = "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, ts::DATE"


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", F.when(e % 4 > 0, F.col("user_id")).alias("staff"), F.when(e % 6 > 0, F.col("event_type")).otherwise(" ").alias("kind"))
    return rules.validated(events, ["staff", "kind"]).filter("missing <> ''").select("event_id", "missing")


INTAKE_SQL = """SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'staff' END, CASE WHEN event_id % 6 = 0 THEN 'kind' END) AS missing FROM events WHERE event_id % 4 = 0 OR event_id % 6 = 0"""


def ask_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = {"origin": F.when(k % 2 > 0, "a"), "destination": F.when(k % 3 > 0, "b"), "vehicle": F.when(k % 5 > 0, "c")}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(missing_fields(fields), ", ").alias("missing"))


ASK_BACK_SQL = "SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'origin' END, CASE WHEN c_custkey % 3 = 0 THEN 'destination' END, CASE WHEN c_custkey % 5 = 0 THEN 'vehicle' END) AS missing FROM customer"


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("amount_in"))
    return rules.recent_payments(events.filter("amount_in > 0")).select("event_id", "amount_in")  # ten minutes up to the latest payment


PAYMENTS_SQL = "SELECT event_id, value AS amount_in FROM events WHERE event_type = 'purchase' AND value > 0 AND ts >= (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND value > 0) - INTERVAL 10 MINUTE"


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), money(F.col("o_totalprice")).alias("order_amount"))
    sums = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 8 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("reference"), (money(F.col("o_totalprice")) + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("amount"))
    return rules.match_payments(sums, orders).groupBy("state").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


MATCHED_SQL = """SELECT CASE WHEN o_orderkey % 8 = 0 AND o_orderkey > 0 THEN 'unknown_reference' WHEN o_orderkey % 5 = 0 THEN 'review' ELSE 'matched' END AS state, count(*) AS n, sum(o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE AS amount FROM orders GROUP BY 1"""


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 50).alias("stock"), F.col("p_size").alias("threshold"))
    return rules.low_stock(p)


STOCK_SQL = "SELECT p_partkey, p_partkey * 7 % 50 AS stock, p_size AS threshold FROM part WHERE p_partkey * 7 % 50 < p_size"


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    least = own.groupBy("brand").agg(F.min("price").alias("rival_price"))
    return rules.above_rivals(own, least, "brand").select("p_partkey", "price", "rival_price")


RIVALS_SQL = """WITH r AS (SELECT p_brand, min(p_retailprice) AS rival_price FROM part GROUP BY p_brand)
SELECT p_partkey, p_retailprice AS price, rival_price FROM part JOIN r USING (p_brand) WHERE p_retailprice > rival_price * 1.1"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom = table(spark, sf_dir, "part").select(F.col("p_brand").alias("product"), F.col("p_type").alias("material"), F.col("p_size").cast("long").alias("per_unit"))
    plan = table(spark, sf_dir, "part").select(F.col("p_brand").alias("product")).distinct().select("product", F.length("product").cast("long").alias("units"))
    held = bom.select("material").distinct().select("material", (F.length("material") * 1000).cast("long").alias("on_hand")).filter("on_hand % 3000 > 0")
    return rules.to_buy(bom, plan, held)


MATERIALS_SQL = """WITH n AS (SELECT p_type AS material, sum(p_size * length(p_brand))::BIGINT AS need FROM part GROUP BY p_type), h AS (SELECT *, CASE WHEN length(material) * 1000 % 3000 > 0 THEN length(material) * 1000 ELSE 0 END AS on_hand FROM n)
SELECT material, need, on_hand, greatest(0, need - on_hand) AS to_buy FROM h"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("start"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 30).cast("int"))).cast("timestamp").alias("now"))  # noqa: E741
    return l.select("event_id", rules.material_window(F.col("start"), F.col("now")).alias("state"))


WINDOWS_SQL = "SELECT event_id, CASE WHEN 24 - event_id % 30 < 0 THEN 'overdue' WHEN 24 - event_id % 30 < 6 THEN 'urgent' ELSE 'ok' END AS state FROM events"


def fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest view's value of its user as price."""
    e = table(spark, sf_dir, "events")
    prices = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("price"))
    return quotes.price_as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), prices, "user_id").select("event_id", "price")


FUEL_SQL = """SELECT e.event_id, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts"""


def profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sales = o.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), money(F.col("o_totalprice")).alias("revenue"), (money(F.col("o_totalprice")) * F.lit("0.7").cast("decimal(2,1)")).alias("cost"))
    r = rules.grouped_profit(sales, ["segment", "priority"])
    return r.select("segment", "priority", F.col("level").cast("long").alias("level"), F.col("revenue").cast("double").alias("revenue"), F.col("profit").cast("double").alias("profit"))


PROFIT_SQL = """SELECT c_mktsegment AS segment, o_orderpriority AS priority, grouping_id(c_mktsegment, o_orderpriority)::BIGINT AS level, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue,
    (sum(o_totalprice::DECIMAL(18,2)) - sum(o_totalprice::DECIMAL(18,2) * 0.7::DECIMAL(2,1)))::DOUBLE AS profit FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workflows: some with a fault each."""
    k = F.col("c_custkey")
    node = lambda name, kind, ok=True: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), (F.lit(1.0) if ok else F.lit(None).cast("double")).alias("typeVersion"), F.array(F.lit(0), F.lit(0)).alias("position"), F.lit(None).cast("string").alias("statement"))
    edge = lambda a, b: F.struct(F.lit(a).alias("src"), F.lit(b).alias("dest"))
    sound = F.array(node("start", "webhook"), node("work", "http"))
    nodes = (
        F.when(k % 7 == 1, F.array(node("start", "webhook"), node("start", "http")))
        .when(k % 7 == 2, F.array(node("start", "webhook"), node("run", "code")))
        .when(k % 7 == 3, F.array(node("start", "webhook"), node("work", "http", False)))
        .when(k % 7 == 4, F.array(node("a", "http"), node("work", "http")))
        .otherwise(sound)
    )
    edges = F.when(k % 7 == 5, F.array(edge("start", "nowhere"))).when(k % 7 == 6, F.array(edge("start", "start"))).otherwise(F.array(edge("start", "work")))
    flows = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), nodes.alias("nodes"), edges.alias("edges"))
    catalog = spark.createDataFrame([("webhook", True), ("http", False)], "type string, is_trigger boolean")
    return rules.validate_workflows(flows, catalog, ["code"])


ORPHANS_SQL = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 1 THEN 'repeated name' WHEN 2 THEN 'blocked type' WHEN 3 THEN 'no version' WHEN 4 THEN 'not one trigger' WHEN 5 THEN 'edge to nowhere' WHEN 6 THEN 'node without an edge' END AS fault FROM customer"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("version"), F.col("p_partkey").alias("position"))
    return rules.harvest_catalog(nodes)


CATALOG_SQL = "SELECT p_type AS type, p_size::BIGINT AS version, p_partkey AS position FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) = 1"


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return new_rows(docs, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


INGEST_SQL = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    changes = base.filter("p_partkey % 3 = 0").select("p_partkey", F.lit(99.5).alias("p_retailprice"))
    return overlay(base, changes, "p_partkey")


PRICES_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 99.5 ELSE p_retailprice END AS p_retailprice FROM part"


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.filter(F.ilike("p_name", F.lit("%AN%"))).orderBy("p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice")


LOOKUP_SQL = "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%AN%' ORDER BY p_partkey LIMIT 20"


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", (10 + F.col("n_nationkey") * 0.5).alias("lat"), (100 + F.col("n_nationkey") * 0.25).alias("lon"))
    return n.select("n_nationkey", F.round(carriers.haversine_km(F.lit(21.0278), F.lit(105.8342), F.col("lat"), F.col("lon")), 6).alias("km"))


DISTANCES_SQL = """SELECT n_nationkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(10 + n_nationkey * .5) - radians(21.0278)) / 2), 2) + cos(radians(21.0278)) * cos(radians(10 + n_nationkey * .5)) * pow(sin((radians(100 + n_nationkey * .25) - radians(105.8342)) / 2), 2))), 6) AS km FROM nation"""


def naive_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MASE of the forecast "as four periods ago" over each customer's orders by month of the year."""
    o = table(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate"))
    counts = o.groupBy("o_custkey").pivot("m", list(range(1, 13))).count().na.fill(0)
    s = F.array(*[F.col(str(i)).cast("double") for i in range(1, 13)])
    predicted = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(s, F.greatest(i - 4, F.lit(1))))
    return counts.select("o_custkey", demand.mase(s, predicted).alias("mase"))


NAIVE_SQL = """WITH c AS (SELECT o_custkey, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT k.o_custkey, r.m, coalesce(c.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT o_custkey FROM orders) k CROSS JOIN range(1, 13) r(m) LEFT JOIN c ON c.o_custkey = k.o_custkey AND c.m = r.m),
e AS (SELECT *, abs(n - CASE WHEN m <= 5 THEN first_value(n) OVER w ELSE lag(n, 4) OVER w END) AS err, abs(n - lag(n) OVER w) AS naive FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY m))
SELECT o_custkey, CASE WHEN avg(naive) > 1e-9 THEN round(avg(err) / avg(naive), 4) END AS mase FROM e GROUP BY o_custkey"""


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for a vehicle on their day; lines are offers of their supplier, rules go by market segment, and fuel is a day's mean view."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    vehicle = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderpriority") != "5-LOW", "R")
    requests = o.select(F.col("o_orderkey").alias("request_id"), vehicle.alias("vehicle_type"), F.col("c_mktsegment").alias("cargo_type"), F.to_date("o_orderdate").alias("day"))
    day = F.to_date("l_shipdate")
    until = F.when((F.col("l_discount") > 0) | (F.col("l_tax") > 0), F.date_add(day, F.col("l_quantity").cast("int")))
    offers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("carrier_id"), F.col("l_returnflag").alias("vehicle_type"), F.col("l_extendedprice").alias("price"), day.alias("valid_from"), until.alias("valid_to"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("place"), F.round(F.avg("c_acctbal") / 100, 4).alias("base_margin_pct"))
    rules_ = c.filter("name <> 'MACHINERY'").select("*", *[F.lit(None).cast("double").alias(x) for x in ("fuel_sensitivity", "fuel_baseline_price", "min_margin_amount", "surcharge_amount", "surcharge_pct")], F.lit(None).cast("string").alias("surcharge_name"))
    e = table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 4).alias("price"))
    fuel = e.select(F.lit("diesel").alias("fuel_type"), F.add_months("date", -60).alias("date"), "price")
    found = quotes.assemble(requests, offers, rules_, fuel)
    return found.select("request_id", "n_offers", "rule_name", "error", "carrier_id", "carrier_cost", "base_margin_pct", "fuel_sensitivity", F.col("current_fuel_price").alias("fuel_price"))


ASSEMBLED_SQL = """WITH rules AS (SELECT c_mktsegment AS name, min(c_custkey) AS place, round(avg(c_acctbal) / 100, 4) AS margin FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1),
fuel AS (SELECT (ts::DATE - INTERVAL 60 MONTH)::DATE AS day, round(avg(value), 4) AS price FROM events WHERE event_type = 'view' GROUP BY ts::DATE),
requests AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'N' WHEN o_orderpriority <> '5-LOW' THEN 'R' END AS vehicle, c_mktsegment AS cargo, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
offers AS (SELECT l_suppkey AS carrier, l_returnflag AS vehicle, l_extendedprice AS price, l_shipdate::DATE AS since, CASE WHEN l_discount > 0 OR l_tax > 0 THEN l_shipdate::DATE + l_quantity::INT ELSE DATE '9999-01-01' END AS until FROM lineitem),
days AS (SELECT DISTINCT vehicle, day FROM requests WHERE vehicle IS NOT NULL),
met AS (SELECT d.vehicle, d.day, count(*) AS n_offers, arg_min(carrier, (price, carrier)) AS carrier, min(price) AS price FROM days d JOIN offers o ON o.vehicle = d.vehicle AND d.day BETWEEN since AND until GROUP BY 1, 2),
told AS (SELECT r.*, m.n_offers, m.carrier, m.price, coalesce(x.name, f.name) AS rule_name, coalesce(x.margin, f.margin) AS margin,
    CASE WHEN r.vehicle IS NULL THEN 'missing: vehicle_type' WHEN m.carrier IS NULL THEN 'no carrier fits' END AS error
    FROM requests r LEFT JOIN met m ON m.vehicle = r.vehicle AND m.day = r.day LEFT JOIN rules x ON x.name = cargo, (SELECT * FROM rules ORDER BY place LIMIT 1) f)
SELECT request_id, coalesce(n_offers, 0) AS n_offers, rule_name, error, CASE WHEN error IS NULL THEN carrier END AS carrier_id, CASE WHEN error IS NULL THEN t.price END AS carrier_cost,
    CASE WHEN error IS NULL THEN margin END AS base_margin_pct, CASE WHEN error IS NULL THEN 0.35::DOUBLE END AS fuel_sensitivity, CASE WHEN error IS NULL THEN u.price END AS fuel_price
FROM told t ASOF LEFT JOIN fuel u ON t.day >= u.day"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events approve the order whose number is a third of theirs; orders are drafts, pending ones those that are open."""
    drafts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("draft_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise(F.lower("o_orderstatus")).alias("status"), F.when(F.col("c_acctbal") > 0, F.concat(F.lower("c_name"), F.lit("@shop.example"))).alias("customer_email")
    )
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("approval_id"), F.floor(F.col("event_id") / 3).alias("draft_id"), "ts")
    return quotes.approve(asked, drafts).select("approval_id", "draft_id", "outcome")


APPROVALS_SQL = """WITH a AS (SELECT event_id AS approval_id, event_id // 3 AS draft_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS r FROM events),
d AS (SELECT o_orderkey AS draft_id, o_orderstatus AS status, c_acctbal > 0 AS reachable FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT approval_id, draft_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'O' THEN 'already' WHEN NOT reachable THEN 'no_email' WHEN r > 1 THEN 'already' ELSE 'sent' END AS outcome FROM a LEFT JOIN d USING (draft_id)"""


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are batches, tested by their lines' figures; parts are lots, each mixed of the part whose number is its size; farmers are suppliers."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    measured = F.inline(F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(c).alias("value"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high")) for n, c, lo, hi in (("discount", "l_discount", None, 0.09), ("tax", "l_tax", 0.0, 0.07), ("quantity", "l_quantity", 2.0, 49.0))]))
    tests = l.select(F.col("l_orderkey").alias("batch"), measured)
    made_of = l.select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("lot"))
    mixed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), F.col("p_size").cast("long").alias("from_lot"))
    found = tracing.trace_batches(tests, made_of, mixed, l.select(F.col("l_partkey").alias("lot"), F.col("l_suppkey").alias("farmer")))
    return found.withColumn("reasons", F.array_join("reasons", "; "))


TRACED_SQL = """WITH RECURSIVE tests AS (SELECT l_orderkey AS batch, unnest(['discount: not in ..0.0900', 'tax: not in 0.0000..0.0700', 'quantity: not in 2.0000..49.0000']) AS reason, unnest([l_discount <= .09, l_tax BETWEEN 0 AND .07, l_quantity BETWEEN 2 AND 49]) AS good FROM lineitem),
gate AS (SELECT batch, bool_and(good) AS passed, coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason) FILTER (NOT good), '') AS reasons FROM tests GROUP BY batch),
own AS (SELECT DISTINCT l_orderkey AS batch, l_partkey AS lot FROM lineitem JOIN gate ON batch = l_orderkey WHERE NOT passed),
walk AS (SELECT batch, lot, 1 AS steps FROM own UNION SELECT batch, p_size::BIGINT, steps + 1 FROM walk JOIN part ON p_partkey = lot WHERE steps < 40),
lots AS (SELECT batch, lot, min(steps) AS steps FROM walk GROUP BY 1, 2),
whose AS (SELECT batch, count(DISTINCT l_suppkey) AS n_farmers, min(l_suppkey) AS first_farmer FROM lots JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = lot GROUP BY batch),
sizes AS (SELECT batch, count(*) AS n_lots, max(steps) AS steps FROM lots GROUP BY batch)
SELECT batch, CASE WHEN passed THEN 'passed' ELSE 'blocked' END AS status, reasons, coalesce(n_lots, 0) AS n_lots, coalesce(n_farmers, 0) AS n_farmers, coalesce(steps, 0)::BIGINT AS steps, first_farmer
FROM gate LEFT JOIN sizes USING (batch) LEFT JOIN whose USING (batch)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of event has a registry of 200 tasks: a user's day, which the day's events update."""
    e = table(spark, sf_dir, "events")
    updates = e.select(F.col("event_type").alias("owner"), F.col("event_id").alias("seq"), F.concat_ws("@", "user_id", F.to_date("ts").cast("string")).alias("task_id"), "props")
    return sessions.registry(updates.withColumnRenamed("props", "status"), 200)


TASKS_SQL = """WITH t AS (SELECT event_type AS owner, user_id || '@' || ts::DATE AS task_id, min(event_id) AS since, arg_max(props, event_id) AS status FROM events GROUP BY 1, 2)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY owner ORDER BY since DESC, task_id DESC) <= 200"""


QUERIES = {
    "overdue_debt": overdue,
    "fefo_allocation": fefo,
    "idempotent_events": idempotent,
    "intake_validation": intake,
    "required_fields": ask_back,
    "payment_poll": payments,
    "payment_match": matched,
    "low_stock": stock,
    "competitor_price": rivals,
    "material_need": materials,
    "material_window": windows,
    "price_asof": fuel,
    "quote_assembly": assembled,
    "approve_once": approvals,
    "task_registry": tasks,
    "lot_trace": traced,
    "profit_rollup": profit,
    "graph_orphans": orphans,
    "catalog_harvest": catalog,
    "incremental_ingest": ingest,
    "price_update": prices,
    "product_lookup": lookup,
    "haversine": distances,
    "mase": naive_error,
}
ORACLES = {
    "overdue_debt": OVERDUE_SQL,
    "fefo_allocation": FEFO_SQL,
    "idempotent_events": IDEMPOTENT_SQL,
    "intake_validation": INTAKE_SQL,
    "required_fields": ASK_BACK_SQL,
    "payment_poll": PAYMENTS_SQL,
    "payment_match": MATCHED_SQL,
    "low_stock": STOCK_SQL,
    "competitor_price": RIVALS_SQL,
    "material_need": MATERIALS_SQL,
    "material_window": WINDOWS_SQL,
    "price_asof": FUEL_SQL,
    "quote_assembly": ASSEMBLED_SQL,
    "approve_once": APPROVALS_SQL,
    "task_registry": TASKS_SQL,
    "lot_trace": TRACED_SQL,
    "profit_rollup": PROFIT_SQL,
    "graph_orphans": ORPHANS_SQL,
    "catalog_harvest": CATALOG_SQL,
    "incremental_ingest": INGEST_SQL,
    "price_update": PRICES_SQL,
    "product_lookup": LOOKUP_SQL,
    "haversine": DISTANCES_SQL,
    "mase": NAIVE_SQL,
}
