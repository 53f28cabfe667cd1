"""Profit and loss by period, its confidence, and products by profit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.money import parse_day, pct, period_key, round_money


def period_totals(sales: DataFrame, expenses: DataFrame, granularity: str) -> DataFrame:
    """Sums per period over sales (date, revenue, cogs) and expenses (date, amount); rows without a readable date are left out.

    Costs count where they are known, and ``covered`` is the revenue of those lines only.
    """
    known = F.col("cogs").isNotNull()
    zero = F.lit(0).cast("decimal(18,4)")
    lines = sales.select(
        period_key(parse_day("date"), granularity).alias("period"),
        F.col("revenue").alias("revenue"),
        F.when(known, F.col("cogs")).otherwise(zero).alias("cogs"),
        F.when(known, F.col("revenue")).otherwise(zero).alias("covered"),
        zero.alias("expenses"),
        F.lit(1).alias("lines"),
    ).unionByName(
        expenses.select(
            period_key(parse_day("date"), granularity).alias("period"),
            zero.alias("revenue"),
            zero.alias("cogs"),
            zero.alias("covered"),
            F.col("amount").alias("expenses"),
            F.lit(0).alias("lines"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("revenue", "cogs", "covered", "expenses", "lines")]
    return lines.filter(F.col("period").isNotNull()).groupBy("period").agg(*sums)


def latest_periods(totals: DataFrame, periods_back: int) -> DataFrame:
    """The latest periods that are present; gaps aren't filled. The ranked rows are one a period."""
    return totals.orderBy(F.desc("period")).limit(periods_back)


def build_report(sales: DataFrame, expenses: DataFrame, granularity: str = "quarter", periods_back: int = 4) -> DataFrame:
    """Revenue, gross and net profit, margins, cost coverage and growth of the latest periods.

    Gross profit is that of lines with known costs. Growth is against the row before within the cut, so
    the first row has none; that of the net is relative to the size of the previous net.
    """
    cut = latest_periods(period_totals(sales, expenses, granularity), periods_back)
    gross = F.col("covered") - F.col("cogs")
    net = gross - F.col("expenses")
    rows = cut.select("period", "lines", "revenue", "cogs", "expenses", "covered", gross.alias("gross"), net.alias("net"))
    order = Window.orderBy("period")  # periods_back rows at most
    before, net_before = F.lag("revenue").over(order), F.lag("net").over(order)
    return rows.select(
        "period",
        F.col("lines").cast("long").alias("lines"),
        round_money(F.col("revenue")).alias("revenue"),
        round_money(F.col("cogs")).alias("cogs"),
        round_money(F.col("expenses")).alias("expenses"),
        round_money(F.col("gross")).alias("gross_profit"),
        round_money(F.col("net")).alias("net_profit"),
        pct(F.col("gross"), F.col("covered")).alias("gross_margin_pct"),
        pct(F.col("net"), F.col("revenue")).alias("net_margin_pct"),
        pct(F.col("covered"), F.col("revenue")).alias("cost_coverage_pct"),
        pct(F.col("revenue") - before, before).alias("revenue_growth_pct"),
        pct(F.col("net") - net_before, F.abs(net_before)).alias("net_growth_pct"),
    )


def report_confidence(sales: DataFrame, expenses: DataFrame, granularity: str = "quarter", periods_back: int = 4) -> DataFrame:
    """Share of the revenue whose costs are known: high from 95 %, medium from 70 %, else low; and unreadable dates."""
    cut = latest_periods(period_totals(sales, expenses, granularity), periods_back)
    share = F.sum("covered").cast("decimal(28,6)") / F.nullif(F.sum(round_money(F.col("revenue"))).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    level = F.when(F.col("coverage") >= 0.95, "high").when(F.col("coverage") >= 0.70, "medium").otherwise("low")
    bad = sales.agg(F.count_if(parse_day("date").isNull()).alias("bad_dates"))
    whole = cut.agg(F.round(share, 4).cast("double").alias("coverage")).withColumn("confidence", level)
    return whole.withColumn("one", F.lit(1)).join(bad.withColumn("one", F.lit(1)), "one").drop("one")


def product_profitability(sales: DataFrame, top_n: int = 10) -> DataFrame:
    """Products by gross profit; it is known only where the costs of all lines are. Unknown ones come last, then by revenue."""
    name = F.coalesce(F.nullif(F.trim("product"), F.lit("")), F.lit("(unknown)"))
    totals = sales.groupBy(name.alias("product")).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count("cogs").alias("known"), F.count("*").alias("lines"), F.sum("cogs").alias("cogs")
    )
    gross = F.when(F.col("known") == F.col("lines"), F.col("revenue") - F.col("cogs"))
    everything = sales.agg(F.sum("revenue").alias("everything"))
    ranked = totals.withColumn("gross", gross).orderBy(F.col("gross").isNull(), F.desc("gross"), F.desc("revenue"), "product").limit(top_n)
    return ranked.withColumn("one", F.lit(1)).join(everything.withColumn("one", F.lit(1)), "one").select(
        "product",
        round_money(F.col("revenue")).alias("revenue"),
        F.col("quantity").cast("double").alias("quantity"),
        round_money(F.col("gross")).alias("gross_profit"),
        pct(F.col("gross"), F.col("revenue")).alias("gross_margin_pct"),
        pct(F.col("revenue"), F.col("everything")).alias("share_pct"),
    )


def sales_totals(sales: DataFrame, as_of: str) -> DataFrame:
    """Sum and number of sales (date, amount) of the day, the week and the month of ``as_of``."""
    day = F.to_date(F.lit(as_of))
    out = []
    for name in ("day", "week", "month"):
        inside = (F.col("date") >= F.to_date(F.date_trunc(name, day))) & (F.col("date") <= day)
        one = sales.filter(inside).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total"), F.count("*").alias("orders"))
        out.append(one.select(F.lit({"day": "today"}.get(name, name)).alias("period"), "total", "orders"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def daily_sales(sales: DataFrame, top_n: int = 5) -> DataFrame:
    """Per day: orders, revenue, distinct customers, and the day's products with the largest revenue, in order."""
    days = sales.groupBy("date").agg(F.countDistinct("order_id").alias("total_orders"), F.sum("revenue").cast("double").alias("total_revenue"), F.countDistinct("customer_id").alias("unique_customers"))
    by_product = sales.groupBy("date", "product").agg(F.sum("revenue").alias("revenue"))
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("revenue"), "product"))
    top = by_product.withColumn("rank", rank).filter(F.col("rank") <= top_n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "product"))), lambda x: x["product"])
    return days.join(top.groupBy("date").agg(F.array_join(listed, "|").alias("top_products")), "date", "left")
