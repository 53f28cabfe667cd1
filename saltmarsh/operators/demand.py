"""Demand of a product: pattern, forecast, error and reorder point, over arrays of periods from old to new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADI_CUTOFF, CV2_CUTOFF = 1.32, 0.49
#: z by service level. Fixed values.
Z = {0.90: 1.2816, 0.95: 1.6449, 0.98: 2.0537, 0.99: 2.3263}
MIN_HISTORY, BACKTEST_MIN, BACKTEST_START = 12, 6, 4


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return _sum(values) / F.nullif(F.size(values), F.lit(0))


def _pstdev(values: Column) -> Column:
    mean = _mean(values)
    return F.sqrt(_mean(F.transform(values, lambda x: (x - mean) * (x - mean))))


def _rounded(x: Column) -> Column:
    """4 decimals, as of a decimal number, so that a half doesn't hang on the last bit."""
    return F.round(x.cast("decimal(18,9)"), 4).cast("double")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once for each row, however often later ones use them: Spark merges no projection into a generator."""
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def classify_demand(df: DataFrame, series: str = "series") -> DataFrame:
    """Add ``adi``, ``cv2`` (4 decimals) and ``pattern``: smooth, erratic, intermittent, lumpy or no_demand.

    ADI is periods over periods with demand; CV2 the squared variation of these (0 for fewer than two). The cutoffs 1.32 and
    0.49 are strict and compared before rounding.
    """
    s = F.col(series)
    positive = F.filter(s, lambda x: x > 0)
    n = F.size(positive)
    cv = _pstdev(positive) / _mean(positive)
    df = _once(df, _n=n, _adi=F.size(s) / F.nullif(n, F.lit(0)), _cv=cv)
    n, adi, cv = F.col("_n"), F.col("_adi"), F.col("_cv")
    cv2 = F.when(n >= 2, cv * cv).when(n == 1, F.lit(0.0))
    pattern = (
        F.when(n == 0, "no_demand")
        .when((adi < ADI_CUTOFF) & (cv2 < CV2_CUTOFF), "smooth")
        .when(adi < ADI_CUTOFF, "erratic")
        .when(cv2 < CV2_CUTOFF, "intermittent")
        .otherwise("lumpy")
    )
    return df.withColumn("pattern", pattern).withColumn("adi", _rounded(adi)).withColumn("cv2", _rounded(cv2)).drop("_n", "_adi", "_cv")


def croston(series: Column, alpha: float = 0.1, variant: str = "sba") -> Column:
    """Demand per period: smoothed size over smoothed interval, with the SBA factor 1 - alpha / 2 unless the variant is another.

    Both start from the first demand (its size, and its place from 1). Without any demand 0.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("gap"))

    def step(state: Column, x: Column) -> Column:
        gap = state["gap"] + 1
        first = state["z"].isNull()
        z = F.when(first, x).otherwise(state["z"] + F.lit(alpha) * (x - state["z"]))
        p = F.when(first, gap).otherwise(state["p"] + F.lit(alpha) * (gap - state["p"]))
        hit = F.struct(z.cast("double").alias("z"), p.cast("double").alias("p"), F.lit(0.0).alias("gap"))
        return F.when(x > 0, hit).otherwise(F.struct(state["z"].alias("z"), state["p"].alias("p"), gap.alias("gap")))

    factor = 1 - alpha / 2 if variant == "sba" else 1.0
    return F.aggregate(series, start, step, lambda s: F.coalesce(s["z"] / s["p"] * factor, F.lit(0.0)))


def moving_average(series: Column, window: int = 4) -> Column:
    """Mean of the last ``window`` periods, or of all if fewer; 0 for none."""
    n = F.size(series)
    last = F.when(n > window, F.slice(series, -window, window)).otherwise(series)
    return F.coalesce(_mean(last), F.lit(0.0))


def mase(actual: Column, predicted: Column) -> Column:
    """Mean absolute error over that of the naive forecast within the series; null for fewer than two, unequal lengths or a flat series."""
    n = F.size(actual)
    error = _mean(F.zip_with(actual, predicted, lambda a, b: F.abs(a - b)))
    naive = _mean(F.zip_with(F.slice(actual, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(actual, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b)))
    return F.when((n >= 2) & (n == F.size(predicted)) & (naive > 1e-9), F.round(error / naive, 4))


def backtest_mase(series: Column, alpha: float = 0.1, variant: str = "sba") -> Column:
    """MASE of one-step forecasts from the fifth period on, each from all periods before; null for fewer than six periods.

    One pass: the fold carries the smoothed size and interval and the sum of the errors so far.
    """
    n = F.size(series)
    factor = 1 - alpha / 2 if variant == "sba" else 1.0
    unknown = F.lit(None).cast("double")
    start = F.struct(unknown.alias("z"), unknown.alias("p"), F.lit(0.0).alias("gap"), F.lit(0).alias("at"), F.lit(0.0).alias("error"))

    def step(state: Column, x: Column) -> Column:
        predicted = F.coalesce(state["z"] / state["p"] * factor, F.lit(0.0))
        error = F.when(state["at"] >= BACKTEST_START, state["error"] + F.abs(x - predicted)).otherwise(state["error"])
        gap, first, hit = state["gap"] + 1, state["z"].isNull(), x > 0
        z = F.when(~hit, state["z"]).when(first, x).otherwise(state["z"] + F.lit(alpha) * (x - state["z"]))
        p = F.when(~hit, state["p"]).when(first, gap).otherwise(state["p"] + F.lit(alpha) * (gap - state["p"]))
        gap = F.when(hit, F.lit(0.0)).otherwise(gap)
        return F.struct(z.cast("double").alias("z"), p.cast("double").alias("p"), gap.alias("gap"), (state["at"] + 1).alias("at"), error.cast("double").alias("error"))

    error = F.aggregate(series, start, step, lambda state: state["error"]) / (n - BACKTEST_START)
    before, after = (F.slice(series, F.lit(i), F.greatest(n - BACKTEST_START - 1, F.lit(0))) for i in (BACKTEST_START + 1, BACKTEST_START + 2))
    naive = _mean(F.zip_with(after, before, lambda a, b: F.abs(a - b)))
    return F.when((n >= BACKTEST_MIN) & (naive > 1e-9), F.round(error / naive, 4))


def forecast_demand(df: DataFrame, alpha: float = 0.1, variant: str = "sba", series: str = "series") -> DataFrame:
    """Add pattern, ``method``, ``forecast`` (4 decimals), ``mase`` and ``confidence``.

    Smooth demand gets the moving average of 4, without an error; other demand Croston's method with its backtest. Confidence is low
    for under 12 periods, under 3 with demand, a lumpy pattern or an error above 1, medium for intermittent or erratic demand.
    """
    rows = classify_demand(df, series)
    usual = F.col("pattern").isin("smooth", "no_demand")
    rows = _once(rows, _mean4=moving_average(F.col(series)), _croston=F.when(~usual, croston(F.col(series), alpha, variant)), _mase=F.when(~usual, backtest_mase(F.col(series), alpha, variant)))
    s, smooth = F.col(series), F.col("pattern") == "smooth"
    n, positive = F.size(s), F.size(F.filter(s, lambda x: x > 0))
    value = F.when(F.col("pattern") == "no_demand", F.lit(0.0)).when(smooth, F.col("_mean4")).otherwise(F.col("_croston"))
    rows = rows.withColumn("method", F.when(F.col("pattern") == "no_demand", "none").when(smooth, "moving_average").otherwise(f"croston_{variant}"))
    rows = rows.withColumn("forecast", F.round(value, 4)).withColumn("mase", F.col("_mase")).drop("_mean4", "_croston", "_mase")
    ladder = F.when((n < MIN_HISTORY) | (positive < 3) | (F.col("pattern") == "lumpy") | (F.col("mase") > 1), "low")
    return rows.withColumn("confidence", ladder.when(F.col("pattern").isin("intermittent", "erratic"), "medium").otherwise("high"))


def reorder_point(df: DataFrame, service_level: float = 0.95, review_periods: int = 0, alpha: float = 0.1, series: str = "series") -> DataFrame:
    """Add ``reorder_point``, ``should_order`` and ``order_quantity`` from series, lead_time_periods and current_stock.

    The level is forecast * h + z * sigma * sqrt(h) with h lead and review periods and sigma over all periods. Unknown stock gives
    no decision. Rows with a negative lead time or without a series get an ``error`` and no figures.
    """
    if round(service_level, 2) not in Z:
        raise ValueError(f"service level must be one of {sorted(Z)}")
    z = Z[round(service_level, 2)]
    bad = F.when(F.col(series).isNull() | (F.size(series) == 0), "empty series").when(F.col("lead_time_periods") < 0, "negative lead time")
    rows = forecast_demand(df, alpha, series=series).withColumn("error", bad)
    h = F.col("lead_time_periods") + review_periods
    rows = _once(rows, _raw=F.when(F.col("error").isNull(), F.col("forecast") * h + F.lit(z) * _pstdev(F.col(series)) * F.sqrt(F.greatest(h, F.lit(0.0)))))
    raw = F.col("_raw")
    quantity = F.greatest(F.lit(0), F.ceil(raw - F.col("current_stock")))
    return (
        rows.withColumn("reorder_point", F.round(raw, 2))
        .withColumn("should_order", F.col("current_stock") <= raw)
        .withColumn("order_quantity", F.when(F.col("current_stock").isNotNull(), quantity).cast("long"))
        .drop("_raw")
    )
