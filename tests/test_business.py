"""Literal expectations of the business operators."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions.money import parse_day, pct, round_step, vat
from saltmarsh.operators import carriers, demand, pricing, reporting

QUOTE = "carrier_cost double, base_margin_pct double, fuel_sensitivity double, fuel_baseline_price double, current_fuel_price double, min_margin_amount double, surcharges array<struct<name:string,amount:double,pct:double>>"


def quote(spark, *row):
    return pricing.compute_quote(spark.createDataFrame([row], QUOTE)).first()


def test_quote_fuel_up_and_down(spark):
    r = quote(spark, 10e6, 10.0, 0.35, 25000.0, 28000.0, 0.0, [])
    assert (r.fuel_adjustment, r.adjusted_cost, r.margin, r.quoted_price) == (420_000, 10_420_000, 1_042_000, 11_462_000)
    assert quote(spark, 10e6, 10.0, 0.35, 25000.0, 22500.0, 0.0, []).fuel_adjustment == -350_000


def test_quote_floor_surcharges_warnings_and_errors(spark):
    r = quote(spark, 1e6, 5.0, 0.35, None, None, 300_000.0, [])
    assert (r.margin, r.margin_floored, r.warnings) == (300_000, True, [])
    r = quote(spark, 10e6, 10.0, 0.35, None, None, 0.0, [("a", 500_000.0, 0.0), ("b", 0.0, 2.0)])
    assert (r.surcharge_total, r.quoted_price) == (700_000, 11_700_000)
    assert quote(spark, 1e6, 5.0, 0.35, None, 25000.0, 0.0, []).warnings
    assert quote(spark, 1e6, 5.0, 0.35, 25000.0, None, 0.0, []).warnings
    assert quote(spark, 0.0, 5.0, 0.35, 25000.0, 25000.0, 0.0, []).error
    assert quote(spark, 1e6, 5.0, 0.35, 25000.0, -1.0, 0.0, []).quoted_price is None


def test_public_view_has_no_inside(spark):
    priced = pricing.compute_quote(spark.createDataFrame([(10e6, 10.0, 0.35, 25000.0, 28000.0, 0.0, [])], QUOTE)).withColumn("id", F.lit(1))
    assert pricing.public_quote(priced, "id").columns == ["id", "surcharge_total", "quoted_price"]


def test_vat_and_invoice(spark):
    items = spark.createDataFrame([(1, 10_000.0, 24, False)], "invoice long, price double, qty int, is_reduced_vat boolean")
    stated = spark.createDataFrame([(1, 264_000.0)], "invoice long, total double")
    r = pricing.check_invoices(items, stated, "invoice").first()
    assert (r.subtotal, r.calculated, r.valid) == (240_000, 264_000, True)
    tax, total = vat(F.lit(1000), F.lit(True))
    assert tuple(spark.range(1).select(tax, total).first()) == (80, 1080)


def test_rounding_and_dates(spark):
    r = spark.range(1).select(round_step(F.lit("1500")), round_step(F.lit("-1500")), pct(F.lit(1), F.lit(0)), parse_day(F.lit("27/07/2026")), parse_day(F.lit("2026-07-27T10:00"))).first()
    assert tuple(r) == (2000, -2000, None, None, date(2026, 7, 27))


SALES = "date string, revenue decimal(18,4), product string, quantity double, cogs decimal(18,4)"


def test_report_growth_coverage_and_unknown_costs(spark):
    from decimal import Decimal as D

    m = 1_000_000
    sales = spark.createDataFrame([("2026-01-05", D(100 * m), "a", 1.0, D(70 * m)), ("2026-04-05", D(150 * m), "a", 1.0, D(100 * m)), ("bad", D(5), "a", 1.0, None)], SALES)
    costs = spark.createDataFrame([("2026-05-01", D(20 * m), "rent")], "date string, amount decimal(18,4), category string")
    q1, q2 = sorted(reporting.build_report(sales, costs).collect())
    assert (q1.gross_profit, q2.gross_profit, q2.net_profit, q2.revenue_growth_pct) == (30 * m, 50 * m, 30 * m, 50.0)
    assert q1.revenue_growth_pct is None
    assert reporting.report_confidence(sales, costs).first().bad_dates == 1
    part = spark.createDataFrame([("2026-01-05", D(100 * m), "a", 1.0, D(60 * m)), ("2026-01-06", D(900 * m), "b", 1.0, None)], SALES)
    r = reporting.build_report(part, costs.limit(0)).first()
    assert (r.gross_profit, r.cost_coverage_pct) == (40 * m, 10.0)
    assert reporting.report_confidence(part, costs.limit(0)).first().confidence == "low"
    assert reporting.build_report(sales.limit(0), costs.limit(0)).count() == 0


def test_products_unknown_last(spark):
    from decimal import Decimal as D

    rows = [("2026-01-01", D(10), "thin", 1.0, D(9)), ("2026-01-01", D(5), "thick", 1.0, D(1)), ("2026-01-01", D(99), "unknown", 1.0, None)]
    assert [r["product"] for r in reporting.product_profitability(spark.createDataFrame(rows, SALES)).collect()] == ["thick", "thin", "unknown"]


CARRIER = "request_id long, carrier_id string, position long, price double, distance_km double, credit_days double, on_time_rate double, discount_pct double, years_partner double"


def test_ranking_prefers_near_and_credit(spark):
    rows = [(1, "A", 0, 1e6, 2.0, 30.0, 0.9, 5.0, 5.0), (1, "B", 1, 9e5, 55.0, 0.0, 0.9, 5.0, 5.0)]
    df = spark.createDataFrame(rows, CARRIER)
    first, second = carriers.rank_carriers(df).orderBy("rank").collect()
    assert (first.carrier_id, second.carrier_id) == ("A", "B") and first.gap == pytest.approx(first.score - second.score)
    price = {r.carrier_id: r.value for r in carriers.criteria(df).filter("criterion = 'price'").collect()}
    assert price == {"A": pytest.approx(0.9), "B": 1.0}


def test_a_criterion_unknown_for_one_counts_for_none(spark):
    rows = [(1, "A", 0, 1e6, 2.0, 30.0, 0.9, 5.0, 5.0), (1, "B", 1, 9e5, 5.0, 10.0, None, 5.0, 5.0)]
    ranked = carriers.rank_carriers(spark.createDataFrame(rows, CARRIER)).collect()
    assert {r.missing for r in ranked} == {"reliability"}
    assert carriers.rank_carriers(spark.createDataFrame(rows, CARRIER), {"reliability": 1.0}).count() == 0


def test_haversine(spark):
    km = spark.range(1).select(carriers.haversine_km(F.lit(21.0278), F.lit(105.8342), F.lit(20.8449), F.lit(106.6881))).first()[0]
    assert 85 < km < 105


def demand_rows(spark, *series):
    return spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(series)], "id long, series array<double>")


def test_demand_patterns(spark):
    df = demand_rows(spark, [0, 0, 5] * 3, [10, 12, 11, 13, 10, 12], [0, 0, 200, 0, 0, 1, 0, 0, 5, 0, 0, 150], [10, 1, 50, 2, 30, 3], [0, 0, 0])
    got = demand.classify_demand(df).orderBy("id").collect()
    assert [r.pattern for r in got] == ["intermittent", "smooth", "lumpy", "erratic", "no_demand"]
    assert got[0].adi == 3.0


def python_croston(series, alpha=0.1, factor=0.95):
    z = p = None
    gap = 0
    for x in series:
        gap += 1
        if x > 0:
            z, p, gap = (x, gap, 0) if z is None else (z + alpha * (x - z), p + alpha * (gap - p), 0)
    return 0.0 if z is None else z / p * factor


def test_croston(spark):
    import random

    r = random.Random(3)
    series = [[0, 0, 5] * 3, [0, 0], *[[r.choice([0, 0, 0, 1, 4, 9]) for _ in range(r.randint(1, 30))] for _ in range(60)]]
    got = demand_rows(spark, *series).select("id", demand.croston(F.col("series")).alias("sba"), demand.croston(F.col("series"), variant="classic").alias("classic")).orderBy("id").collect()
    assert got[0].classic == pytest.approx(5 / 3)
    for row, s in zip(got, series, strict=True):
        assert row.sba == pytest.approx(python_croston(s))
    with pytest.raises(ValueError):
        demand.croston(F.col("series"), alpha=1.0)


def test_mase_and_moving_average(spark):
    df = demand_rows(spark, [1, 2, 4], [3, 3, 3], [1], [])
    s = F.col("series")
    got = df.select("id", demand.mase(s, s).alias("m"), demand.moving_average(s).alias("a")).orderBy("id").collect()
    assert [r.m for r in got] == [0.0, None, None, None] and got[3].a == 0.0


def test_reorder_quarantines_and_decides(spark):
    df = spark.createDataFrame([(1, [10.0] * 12, 5.0, 1.0), (2, [10.0] * 12, None, 1.0), (3, [10.0] * 12, 5.0, -1.0)], "id long, series array<double>, current_stock double, lead_time_periods double")
    a, b, c = demand.reorder_point(df).orderBy("id").collect()
    assert (a.reorder_point, a.should_order, a.order_quantity) == (10.0, True, 5)
    assert b.should_order is None and b.order_quantity is None and c.error and c.reorder_point is None
    with pytest.raises(ValueError):
        demand.reorder_point(df, 0.5)


def test_breakdown_adds_up_to_the_score(spark):
    rows = [(1, "A", 0, 1e6, 2.0, 30.0, 0.9, 5.0, 5.0), (1, "B", 1, 9e5, 5.0, 10.0, None, 5.0, 5.0), (2, "A", 0, 0.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, CARRIER)
    parts = carriers.breakdown(df).collect()
    for r in carriers.rank_carriers(df).collect():
        own = sorted((p for p in parts if (p.request_id, p.carrier_id) == (r.request_id, r.carrier_id)), key=lambda p: p.place)
        assert sum(p.contribution for p in own) == pytest.approx(r.score, abs=5e-4) and sum(p.weight for p in own) == pytest.approx(1, abs=5e-4)
        assert [p.contribution for p in own] == sorted((p.contribution for p in own), reverse=True) and "reliability" not in {p.criterion for p in own}
    assert carriers.breakdown(df, {"reliability": 1.0}).count() == 0 and [p.criterion for p in parts if p.request_id == 2] == ["price"]


@pytest.mark.parametrize(("cost", "margin", "adjusted"), [(4.9996, 1, 5), (4.9994, 0, 5)])
def test_figures_are_rounded_from_four_decimals(spark, cost, margin, adjusted):
    """As in the SQL: a tenth of 4.9996 is kept as 0.5000, so the margin is 1."""
    schema = QUOTE.replace("carrier_cost double", "carrier_cost decimal(18,4)")
    r = pricing.compute_quote(spark.createDataFrame([(Decimal(str(cost)), 10.0, 0.35, None, None, 0.0, [])], schema)).first()
    assert (r.margin, r.adjusted_cost) == (margin, adjusted)
