"""Queries of the business operators over the star schema, with their DuckDB counterparts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.money import money
from saltmarsh.operators import carriers, demand, pricing, reporting
from saltmarsh.sources.tables import table

AS_OF = "2001-06-15"

# ---- sales and expenses ----------------------------------------------------------------------------


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sale line for each line item; costs are unknown for returned ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", money(F.col("p_retailprice")).alias("cost"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    revenue = money(F.col("l_extendedprice")) * (F.lit(1).cast("decimal(18,2)") - money(F.col("l_discount")))
    cogs = F.when(F.col("l_returnflag") != "R", F.col("cost") * money(F.col("l_quantity")) * F.lit("0.6").cast("decimal(2,1)"))
    return rows.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        revenue.cast("decimal(18,4)").alias("revenue"),
        F.col("p_name").alias("product"),
        F.col("l_quantity").alias("quantity"),
        cogs.cast("decimal(18,4)").alias("cogs"),
    )


def expense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expense line for each tenth order: 2 % of its total."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 == 0)
    amount = money(F.col("o_totalprice")) * F.lit("0.02").cast("decimal(3,2)")
    return orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), amount.cast("decimal(18,4)").alias("amount"), F.col("o_orderpriority").alias("category"))


SALES = """sales AS (
    SELECT o_orderdate::DATE AS day, o_orderkey AS order_id, o_custkey AS customer_id, p_name AS product, l_quantity AS quantity,
           (l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(18,2) - l_discount::DECIMAL(18,2)))::DECIMAL(18,4) AS revenue,
           CASE WHEN l_returnflag <> 'R' THEN (p_retailprice::DECIMAL(18,2) * l_quantity::DECIMAL(18,2) * 0.6::DECIMAL(2,1))::DECIMAL(18,4) END AS cogs
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
EXPENSES = """expenses AS (
    SELECT o_orderdate::DATE AS day, (o_totalprice::DECIMAL(18,2) * 0.02::DECIMAL(3,2))::DECIMAL(18,4) AS amount FROM orders WHERE o_orderkey % 10 = 0)"""
PERIODS = {
    "month": "strftime(day, '%Y-%m')",
    "quarter": "strftime(day, '%Y') || '-Q' || quarter(day)",
    "half": "strftime(day, '%Y') || CASE WHEN month(day) <= 6 THEN '-H1' ELSE '-H2' END",
    "year": "strftime(day, '%Y')",
}


def _cut(granularity: str, back: int) -> str:
    key = PERIODS[granularity]
    return f"""totals AS (
    SELECT period, sum(lines) AS lines, sum(revenue) AS revenue, sum(cogs) AS cogs, sum(covered) AS covered, sum(amount) AS expenses FROM (
        SELECT {key} AS period, 1 AS lines, revenue, coalesce(cogs, 0) AS cogs, CASE WHEN cogs IS NULL THEN 0 ELSE revenue END AS covered, 0 AS amount FROM sales
        UNION ALL SELECT {key}, 0, 0, 0, 0, amount FROM expenses) GROUP BY period),
cut AS (SELECT *, covered - cogs AS gross, covered - cogs - expenses AS net FROM totals ORDER BY period DESC LIMIT {back})"""


def _pct(part: str, whole: str) -> str:
    return f"round(({part})::DECIMAL(28,6)::DOUBLE / nullif(({whole})::DECIMAL(28,6)::DOUBLE, 0) * 100, 2)"


def _report_sql(granularity: str, back: int) -> str:
    return f"""WITH {SALES}, {EXPENSES}, {_cut(granularity, back)}
SELECT period, lines::BIGINT AS lines, round(revenue, 0)::BIGINT AS revenue, round(cogs, 0)::BIGINT AS cogs, round(expenses, 0)::BIGINT AS expenses,
       round(gross, 0)::BIGINT AS gross_profit, round(net, 0)::BIGINT AS net_profit,
       {_pct('gross', 'covered')} AS gross_margin_pct, {_pct('net', 'revenue')} AS net_margin_pct, {_pct('covered', 'revenue')} AS cost_coverage_pct,
       {_pct('revenue - lag(revenue) OVER w', 'lag(revenue) OVER w')} AS revenue_growth_pct,
       {_pct('net - lag(net) OVER w', 'abs(lag(net) OVER w)')} AS net_growth_pct
FROM cut WINDOW w AS (ORDER BY period)"""


def report(spark: SparkSession, sf_dir: str, granularity: str, back: int) -> DataFrame:
    return reporting.build_report(sale_lines(spark, sf_dir), expense_lines(spark, sf_dir), granularity, back)


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.report_confidence(sale_lines(spark, sf_dir), expense_lines(spark, sf_dir))


CONFIDENCE_SQL = f"""WITH {SALES}, {EXPENSES}, {_cut('quarter', 4)}, c AS (
    SELECT round(sum(covered)::DECIMAL(28,6)::DOUBLE / sum(round(revenue, 0)::BIGINT)::DOUBLE, 4) AS coverage FROM cut)
SELECT coverage, CASE WHEN coverage >= .95 THEN 'high' WHEN coverage >= .7 THEN 'medium' ELSE 'low' END AS confidence, 0::BIGINT AS bad_dates FROM c"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.product_profitability(sale_lines(spark, sf_dir), 20)


PRODUCTS_SQL = f"""WITH {SALES}, t AS (
    SELECT coalesce(nullif(trim(product), ''), '(unknown)') AS product, sum(revenue) AS revenue, sum(quantity) AS quantity,
           CASE WHEN count(cogs) = count(*) THEN sum(revenue) - sum(cogs) END AS gross FROM sales GROUP BY 1),
r AS (SELECT *, sum(revenue) OVER () AS everything FROM t ORDER BY gross IS NULL, gross DESC, revenue DESC, product LIMIT 20)
SELECT product, round(revenue, 0)::BIGINT AS revenue, quantity::DOUBLE AS quantity, round(gross, 0)::BIGINT AS gross_profit,
       {_pct('gross', 'revenue')} AS gross_margin_pct, {_pct('revenue', 'everything')} AS share_pct FROM r"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), money(F.col("o_totalprice")).alias("amount"))
    return reporting.sales_totals(orders, AS_OF)


TOTALS_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS period, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS total, count(*) AS orders FROM orders
    WHERE o_orderdate::DATE >= date_trunc('{unit}', DATE '{AS_OF}') AND o_orderdate::DATE <= DATE '{AS_OF}'"""
    for name, unit in (("today", "day"), ("week", "week"), ("month", "month"))
)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.daily_sales(sale_lines(spark, sf_dir), 5)


DAILY_SQL = f"""WITH {SALES}, d AS (SELECT day, count(DISTINCT order_id) AS total_orders, sum(revenue)::DOUBLE AS total_revenue, count(DISTINCT customer_id) AS unique_customers FROM sales GROUP BY day),
p AS (SELECT day, product, row_number() OVER (PARTITION BY day ORDER BY sum(revenue) DESC, product) AS r FROM sales GROUP BY day, product)
SELECT strftime(d.day, '%Y-%m-%d') AS date, total_orders, total_revenue, unique_customers, string_agg(product, '|' ORDER BY r) AS top_products
FROM d JOIN p ON d.day = p.day AND r <= 5 GROUP BY ALL"""

# ---- quotes and invoices ------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str, surcharges: bool) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    none = F.array().cast("array<struct<name:string,amount:decimal(18,2),pct:decimal(9,4)>>")
    some = F.array(
        F.struct(F.lit("handling").alias("name"), F.lit(500000).cast("decimal(18,2)").alias("amount"), F.lit(0).cast("decimal(9,4)").alias("pct")),
        F.struct(F.lit("risk").alias("name"), F.lit(0).cast("decimal(18,2)").alias("amount"), (k % 4).cast("decimal(9,4)").alias("pct")),
    )
    return orders.select(
        k.alias("request_id"),
        F.when(k % 50 == 0, F.lit(0)).otherwise(money(F.col("o_totalprice")) * 100).cast("decimal(18,2)").alias("carrier_cost"),
        F.lit(10).cast("decimal(9,4)").alias("base_margin_pct"),
        F.lit("0.35").cast("decimal(9,4)").alias("fuel_sensitivity"),
        F.when(k % 5 > 0, F.lit(25000)).cast("decimal(18,2)").alias("fuel_baseline_price"),
        F.when(k % 7 > 0, 22500 + (k % 11) * 550).cast("decimal(18,2)").alias("current_fuel_price"),
        F.lit(1500000).cast("decimal(18,2)").alias("min_margin_amount"),
        (some if surcharges else none).alias("surcharges"),
    )


def quotes(spark: SparkSession, sf_dir: str, surcharges: bool) -> DataFrame:
    priced = pricing.compute_quote(_requests(spark, sf_dir, surcharges))
    return priced.select("request_id", "fuel_adjustment", "adjusted_cost", "surcharge_total", "margin", "margin_floored", "quoted_price", F.array_join("warnings", ";").alias("warnings"), "error")


def _quotes_sql(surcharges: bool) -> str:
    pct_of = "(o_orderkey % 4)" if surcharges else "0"
    flat = "500000" if surcharges else "0"
    return f"""WITH r AS (
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice::DECIMAL(18,2) * 100 END::DECIMAL(28,6) AS cost,
           CASE WHEN o_orderkey % 5 > 0 THEN 25000 END AS base, CASE WHEN o_orderkey % 7 > 0 THEN 22500 + (o_orderkey % 11) * 550 END AS fuel, {pct_of} AS pct FROM orders),
a AS (SELECT *, CASE WHEN fuel IS NOT NULL AND base IS NOT NULL THEN (cost::DOUBLE * 0.35 * (fuel::DOUBLE / base - 1)) ELSE 0 END::DECIMAL(28,4) AS adj FROM r),
b AS (SELECT *, (cost + adj)::DECIMAL(28,4) AS adjusted FROM a),
c AS (SELECT *, ({flat} + adjusted * pct / 100)::DECIMAL(28,4) AS sur, (adjusted * 10 / 100)::DECIMAL(28,4) AS share FROM b),
d AS (SELECT *, greatest(share, 1500000) AS margin FROM c)
SELECT id AS request_id, CASE WHEN cost > 0 THEN round(adj, 0)::BIGINT END AS fuel_adjustment, CASE WHEN cost > 0 THEN round(adjusted, 0)::BIGINT END AS adjusted_cost,
       CASE WHEN cost > 0 THEN round(sur, 0)::BIGINT END AS surcharge_total, CASE WHEN cost > 0 THEN round(margin, 0)::BIGINT END AS margin,
       CASE WHEN cost > 0 THEN share < 1500000 END AS margin_floored,
       CASE WHEN cost > 0 THEN (round((adjusted + sur + margin) / 1000, 0) * 1000)::BIGINT END AS quoted_price,
       CASE WHEN cost > 0 THEN CASE WHEN fuel IS NOT NULL AND base IS NULL THEN 'no baseline fuel price: fuel not adjusted'
            WHEN fuel IS NULL AND base IS NOT NULL THEN 'no current fuel price: fuel not adjusted' ELSE '' END END AS warnings,
       CASE WHEN cost > 0 THEN NULL ELSE 'carrier_cost must be positive' END AS error FROM d"""


def public_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.public_quote(pricing.compute_quote(_requests(spark, sf_dir, True)), "request_id")


PUBLIC_SQL = f"SELECT request_id, surcharge_total, quoted_price FROM ({_quotes_sql(True)}) WHERE error IS NULL"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice"),
        money(F.col("l_extendedprice")).alias("price"),
        (F.col("l_linenumber") % 3).cast("int").alias("qty"),
        F.when(F.col("l_returnflag") == "R", F.lit(True)).when(F.col("l_returnflag") == "A", F.lit(False)).alias("is_reduced_vat"),
    )


VAT_LINES = """lines AS (
    SELECT l_orderkey AS invoice, l_linenumber, b AS line_base_raw, round(b, 0)::BIGINT AS line_base,
           round(b * CASE WHEN l_returnflag = 'R' THEN 0.08 ELSE 0.10 END, 0)::BIGINT AS line_tax
    FROM (SELECT *, (l_extendedprice::DECIMAL(18,2) * CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_linenumber % 3 END)::DECIMAL(24,4) AS b FROM lineitem))"""


def vat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pricing.invoice_lines(_items(spark, sf_dir))
    return lines.groupBy("invoice").agg(F.sum("line_base").alias("subtotal"), F.sum("line_tax").alias("vat_amount"), F.sum("line_total").alias("total"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pricing.invoice_lines(_items(spark, sf_dir)).groupBy("invoice").agg(F.sum("line_total").alias("t"))
    stated = lines.select("invoice", (F.col("t") + (F.col("invoice") % 5) * 40).cast("decimal(18,2)").alias("total"))
    return pricing.check_invoices(_items(spark, sf_dir), stated, "invoice")


INVOICES_SQL = f"""WITH {VAT_LINES}, s AS (SELECT invoice, sum(line_base) AS subtotal, sum(line_tax) AS vat_amount, sum(line_base + line_tax) AS calculated FROM lines GROUP BY invoice)
SELECT invoice, subtotal::BIGINT AS subtotal, vat_amount::BIGINT AS vat_amount, calculated::BIGINT AS calculated, ((invoice % 5) * 40)::DOUBLE AS difference,
       (invoice % 5) * 40 <= greatest(10, 0.001 * (calculated + (invoice % 5) * 40)) AS valid FROM s"""

# ---- carriers ------------------------------------------------------------------------------------------

TYPES = ("1.5T", "3T", "5T", "8T")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (nations) and carriers (suppliers of the same region) with their last offer: a line item of the supplier."""
    nations = table(spark, sf_dir, "nation")
    requests = nations.select(
        F.col("n_nationkey").cast("long").alias("request_id"),
        F.col("n_regionkey").alias("region"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("vehicle_type"),
        (10 + F.col("n_nationkey") * 0.1).alias("lat"),
        (105 + F.col("n_nationkey") * 0.05).alias("lon"),
    )
    s = F.col("s_suppkey")
    every = F.array(*[F.lit(t) for t in TYPES])
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = suppliers.select(
        s.alias("carrier_id"),
        F.col("n_regionkey").alias("region"),
        s.alias("position"),
        F.when(s % 4 > 0, F.slice(every, F.lit(1), (s % 4).cast("int"))).otherwise(F.array().cast("array<string>")).alias("vehicle_types"),
        (10 + (s % 40) * 0.05).alias("depot_lat"),
        (105 + (s % 30) * 0.05).alias("depot_lon"),
        (s % 46).cast("double").alias("credit_days"),
        F.when(s % 9 > 0, (s % 21).cast("double")).alias("discount_pct"),
        (s % 12).cast("double").alias("years_partner"),
        ((s % 10) / 10.0).alias("on_time_rate"),
    )
    offers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("carrier_id"), (F.col("l_partkey") % 25).alias("request_id"), money(F.col("l_extendedprice")).cast("double").alias("price"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    last = carriers.latest_offers(offers, "at")
    pairs = requests.join(suppliers, "region")
    away = carriers.haversine_km(F.col("lat"), F.col("lon"), F.col("depot_lat"), F.col("depot_lon"))
    return carriers.hard_filter(pairs.join(last, ["request_id", "carrier_id"], "left").withColumn("distance_km", away))


CANDIDATES = """req AS (SELECT n_nationkey::BIGINT AS request_id, n_regionkey AS region, ['1.5T','3T','5T','8T'][(n_nationkey % 4 + 1)::INT] AS vehicle_type, 10 + n_nationkey * 0.1 AS lat, 105 + n_nationkey * 0.05 AS lon FROM nation),
car AS (SELECT s_suppkey AS carrier_id, n_regionkey AS region, ['1.5T','3T','5T','8T'][1:(s_suppkey % 4)::INT] AS vehicle_types, 10 + (s_suppkey % 40) * 0.05 AS dlat, 105 + (s_suppkey % 30) * 0.05 AS dlon,
    (s_suppkey % 46)::DOUBLE AS credit_days, CASE WHEN s_suppkey % 9 > 0 THEN (s_suppkey % 21)::DOUBLE END AS discount_pct, (s_suppkey % 12)::DOUBLE AS years_partner, (s_suppkey % 10) / 10.0 AS on_time_rate
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
off AS (SELECT l_suppkey AS carrier_id, l_partkey % 25 AS request_id, arg_max(l_extendedprice::DECIMAL(18,2)::DOUBLE, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY 1, 2),
cand AS (SELECT request_id, carrier_id, price, credit_days, discount_pct, years_partner, on_time_rate,
    2 * 6371.0 * asin(sqrt(pow(sin((radians(dlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(dlat)) * pow(sin((radians(dlon) - radians(lon)) / 2), 2))) AS distance_km,
    CASE WHEN len(vehicle_types) > 0 AND NOT list_contains(vehicle_types, vehicle_type) THEN 'no such vehicle' WHEN price IS NULL THEN 'no offer' END AS reason
    FROM req JOIN car USING (region) LEFT JOIN off USING (request_id, carrier_id))"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("request_id", F.coalesce("reason", F.lit("eligible")).alias("outcome")).agg(F.count("*").alias("carriers"), F.round(F.avg("distance_km"), 4).alias("mean_km"))


FILTER_SQL = f"WITH {CANDIDATES} SELECT request_id, coalesce(reason, 'eligible') AS outcome, count(*) AS carriers, round(avg(distance_km), 4) AS mean_km FROM cand GROUP BY 1, 2"


def ranked(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    weights = {k: v for k, v in carriers.WEIGHTS.items() if k not in without}
    return carriers.rank_carriers(_candidates(spark, sf_dir).filter(F.col("reason").isNull()), weights)


def _rank_sql(without: tuple[str, ...] = ()) -> str:
    w = {k: (0 if k in without else v) for k, v in carriers.WEIGHTS.items()}
    return f"""WITH {CANDIDATES}, e AS (SELECT * FROM cand WHERE reason IS NULL),
v AS (SELECT request_id, carrier_id, unnest([
    {{'c': 'price', 'w': {w['price']}::DOUBLE, 'x': CASE WHEN price <= 0 THEN 0 ELSE min(price) OVER (PARTITION BY request_id) / price END}},
    {{'c': 'proximity', 'w': {w['proximity']}::DOUBLE, 'x': 1 - least(1, greatest(0, distance_km / 60.0))}},
    {{'c': 'credit', 'w': {w['credit']}::DOUBLE, 'x': least(1, greatest(0, credit_days / 45.0))}},
    {{'c': 'reliability', 'w': {w['reliability']}::DOUBLE, 'x': least(1, greatest(0, on_time_rate))}},
    {{'c': 'discount', 'w': {w['discount']}::DOUBLE, 'x': CASE WHEN discount_pct IS NOT NULL THEN least(1, greatest(0, discount_pct / 20.0)) END}},
    {{'c': 'tenure', 'w': {w['tenure']}::DOUBLE, 'x': least(1, greatest(0, years_partner / 10.0))}}]) AS k FROM e),
u AS (SELECT request_id, carrier_id, k.c AS c, k.w AS w, k.x AS x, count(k.x) OVER g = count(*) OVER g AS usable FROM v WINDOW g AS (PARTITION BY request_id, k.c)),
s AS (SELECT request_id, carrier_id, round(sum(w * x) FILTER (usable) / sum(w) FILTER (usable), 4) AS score, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT usable), '') AS missing FROM u GROUP BY 1, 2 HAVING sum(w) FILTER (usable) > 0)
SELECT request_id, carrier_id, row_number() OVER o AS rank, score, missing, round(score - lead(score) OVER o, 4) AS gap, round(score - lead(score) OVER o, 4) < 0.05 AS close_call
FROM s WINDOW o AS (PARTITION BY request_id ORDER BY score DESC, carrier_id)"""


def broken_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.breakdown(_candidates(spark, sf_dir).filter(F.col("reason").isNull()))


BREAKDOWN_SQL = _rank_sql().rpartition("s AS (SELECT request_id, carrier_id, round(sum(w * x)")[0] + f"""b AS (SELECT request_id, carrier_id, c AS criterion, round(x, 4) AS normalized, round(w / sum(w) OVER k, 4) AS weight, round(x * w / sum(w) OVER k, 4) AS contribution
    FROM u WHERE usable WINDOW k AS (PARTITION BY request_id, carrier_id))
SELECT *, row_number() OVER (PARTITION BY request_id, carrier_id ORDER BY contribution DESC, list_position({list(carriers.WEIGHTS)}, criterion)) AS place FROM b"""


# ---- demand --------------------------------------------------------------------------------------------

MONTHS = 24


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each part in the last 24 months of the data, months without demand as 0."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"))
    last = lines.agg(F.max("m").alias("last")).withColumn("one", F.lit(1))
    sums = lines.withColumn("one", F.lit(1)).join(last, "one").filter(F.col("m") > F.col("last") - MONTHS)
    sums = sums.groupBy("l_partkey", (F.col("m") - F.col("last") + MONTHS - 1).cast("int").alias("i")).agg(F.sum("l_quantity").alias("q"))
    held = sums.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("by"))
    values = F.transform(F.sequence(F.lit(0), F.lit(MONTHS - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0.0)))
    return held.select(
        F.col("l_partkey").alias("sku"),
        values.alias("series"),
        F.when(F.col("l_partkey") % 6 > 0, (F.col("l_partkey") % 40).cast("double")).alias("current_stock"),
        (F.col("l_partkey") % 3 - F.when(F.col("l_partkey") % 100 == 0, 3).otherwise(0)).cast("double").alias("lead_time_periods"),
    )


SERIES = f"""l AS (SELECT l_partkey AS sku, l_quantity AS q, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem),
q AS (SELECT sku, (m - (SELECT max(m) FROM l) + {MONTHS - 1})::INT AS i, sum(q) AS q FROM l WHERE m > (SELECT max(m) FROM l) - {MONTHS} GROUP BY 1, 2),
g AS (SELECT sku, i, coalesce(q, 0)::DOUBLE AS q FROM (SELECT DISTINCT sku FROM q) CROSS JOIN range({MONTHS}) r(i) LEFT JOIN q USING (sku, i)),
ser AS (SELECT sku, list(q ORDER BY i) AS s, avg(q) AS mean, stddev_pop(q) AS sd, count(*) FILTER (q > 0) AS pos, avg(q) FILTER (q > 0) AS pmean, stddev_pop(q) FILTER (q > 0) AS psd FROM g GROUP BY sku),
prof AS (SELECT *, {MONTHS}::DOUBLE / nullif(pos, 0) AS adi, CASE WHEN pos >= 2 THEN (psd / pmean) * (psd / pmean) WHEN pos = 1 THEN 0 END AS cv2 FROM ser),
pat AS (SELECT *, CASE WHEN pos = 0 THEN 'no_demand' WHEN adi < 1.32 AND cv2 < .49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < .49 THEN 'intermittent' ELSE 'lumpy' END AS pattern FROM prof)"""


def _croston_sql(s: str) -> str:
    step = """CASE WHEN x.v > 0 THEN {'v': 0::DOUBLE, 'z': CASE WHEN a.z IS NULL THEN x.v ELSE a.z + 0.1::DOUBLE * (x.v - a.z) END, 'p': CASE WHEN a.z IS NULL THEN a.gap + 1 ELSE a.p + 0.1::DOUBLE * (a.gap + 1 - a.p) END, 'gap': 0::DOUBLE}
        ELSE {'v': 0::DOUBLE, 'z': a.z, 'p': a.p, 'gap': a.gap + 1} END"""
    none = "{'v': 0::DOUBLE, 'z': NULL::DOUBLE, 'p': NULL::DOUBLE, 'gap': 0::DOUBLE}"
    each = f"list_transform({s}, lambda e: {{'v': e, 'z': NULL::DOUBLE, 'p': NULL::DOUBLE, 'gap': 0::DOUBLE}})"
    return f"(SELECT coalesce(c.z / c.p * 0.95::DOUBLE, 0) FROM (SELECT list_reduce({each}, lambda a, x: {step}, {none}) AS c))"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.classify_demand(series(spark, sf_dir)).select("sku", "pattern", "adi", "cv2")


PROFILE_SQL = f"WITH {SERIES} SELECT sku, pattern, round(adi::DECIMAL(18,9), 4)::DOUBLE AS adi, round(cv2::DECIMAL(18,9), 4)::DOUBLE AS cv2 FROM pat"


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("series")
    return series(spark, sf_dir).select("sku", F.round(demand.croston(s), 4).alias("croston_sba"), F.round(demand.moving_average(s), 4).alias("moving_average_4"))


SMOOTHED_SQL = f"WITH {SERIES} SELECT sku, round({_croston_sql('s')}, 4) AS croston_sba, round(list_avg(s[-4:]), 4) AS moving_average_4 FROM ser"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.forecast_demand(series(spark, sf_dir)).select("sku", "pattern", "method", "forecast", "mase", "confidence")


_FORECAST = f"""bt AS (SELECT sku, t, s[t + 1] AS actual, {_croston_sql('s[1:t]')} AS predicted, lag(s[t + 1]) OVER (PARTITION BY sku ORDER BY t) AS before FROM (SELECT sku, s, unnest(range(4, {MONTHS}))::INT AS t FROM ser)),
err AS (SELECT sku, CASE WHEN avg(abs(actual - before)) > 1e-9 THEN round(avg(abs(actual - predicted)) / avg(abs(actual - before)), 4) END AS mase FROM bt GROUP BY sku),
fc AS (SELECT sku, s, sd, pos, pattern, CASE WHEN pattern = 'no_demand' THEN 'none' WHEN pattern = 'smooth' THEN 'moving_average' ELSE 'croston_sba' END AS method,
    round(CASE WHEN pattern = 'no_demand' THEN 0 WHEN pattern = 'smooth' THEN list_avg(s[-4:]) ELSE {_croston_sql('s')} END, 4) AS forecast,
    CASE WHEN pattern NOT IN ('smooth', 'no_demand') THEN mase END AS mase FROM pat JOIN err USING (sku))"""
FORECAST_SQL = f"""WITH {SERIES}, {_FORECAST} SELECT sku, pattern, method, forecast, mase,
    CASE WHEN pos < 3 OR pattern = 'lumpy' OR mase > 1 THEN 'low' WHEN pattern IN ('intermittent', 'erratic') THEN 'medium' ELSE 'high' END AS confidence FROM fc"""


def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.reorder_point(series(spark, sf_dir), 0.95, 1).select("sku", "forecast", "reorder_point", "should_order", "order_quantity", "error")


REORDER_SQL = f"""WITH {SERIES}, {_FORECAST}, r AS (SELECT *, CASE WHEN sku % 6 > 0 THEN (sku % 40)::DOUBLE END AS stock, sku % 3 - CASE WHEN sku % 100 = 0 THEN 3 ELSE 0 END AS lead FROM fc),
x AS (SELECT *, CASE WHEN lead >= 0 THEN forecast * (lead + 1) + 1.6449 * sd * sqrt(greatest(lead + 1, 0)) END AS raw FROM r)
SELECT sku, forecast, round(raw, 2) AS reorder_point, stock <= raw AS should_order,
    CASE WHEN stock IS NOT NULL AND raw IS NOT NULL THEN greatest(0, ceil(raw - stock))::BIGINT WHEN stock IS NOT NULL THEN 0 END AS order_quantity,
    CASE WHEN lead < 0 THEN 'negative lead time' END AS error FROM x"""


QUERIES = {
    "report_month": partial(report, granularity="month", back=12),
    "report_quarter": partial(report, granularity="quarter", back=4),
    "report_half": partial(report, granularity="half", back=4),
    "report_year": partial(report, granularity="year", back=3),
    "report_confidence": confidence,
    "product_profitability": products,
    "sales_today_week_month": totals,
    "daily_sales_top_products": daily,
    "quote_basic": partial(quotes, surcharges=False),
    "quote_surcharges": partial(quotes, surcharges=True),
    "quote_public_view": public_quotes,
    "vat_lines": vat_lines,
    "invoice_check": invoices,
    "carrier_hard_filter": filtered,
    "carrier_rank": ranked,
    "carrier_rank_without_price": partial(ranked, without=("price",)),
    "carrier_breakdown": broken_down,
    "demand_profile": profile,
    "croston_and_moving_average": smoothed,
    "forecast_confidence": forecasts,
    "reorder_point": reorder,
}
ORACLES = {
    "report_month": _report_sql("month", 12),
    "report_quarter": _report_sql("quarter", 4),
    "report_half": _report_sql("half", 4),
    "report_year": _report_sql("year", 3),
    "report_confidence": CONFIDENCE_SQL,
    "product_profitability": PRODUCTS_SQL,
    "sales_today_week_month": TOTALS_SQL,
    "daily_sales_top_products": DAILY_SQL,
    "quote_basic": _quotes_sql(False),
    "quote_surcharges": _quotes_sql(True),
    "quote_public_view": PUBLIC_SQL,
    "vat_lines": f"WITH {VAT_LINES} SELECT invoice, sum(line_base)::BIGINT AS subtotal, sum(line_tax)::BIGINT AS vat_amount, sum(line_base + line_tax)::BIGINT AS total FROM lines GROUP BY invoice",
    "invoice_check": INVOICES_SQL,
    "carrier_hard_filter": FILTER_SQL,
    "carrier_rank": _rank_sql(),
    "carrier_rank_without_price": _rank_sql(("price",)),
    "carrier_breakdown": BREAKDOWN_SQL,
    "demand_profile": PROFILE_SQL,
    "croston_and_moving_average": SMOOTHED_SQL,
    "forecast_confidence": FORECAST_SQL,
    "reorder_point": REORDER_SQL,
}
