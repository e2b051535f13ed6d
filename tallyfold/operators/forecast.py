"""Closed-form drift forecasts, walk-forward backtests, scenario summaries."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.stats import by, ratio
from tallyfold.operators.scan import percentiles
from tallyfold.sources.shared import staged


def drift_forecast(series: DataFrame, keys: list[str], horizon: int, value: str = "value", levels: tuple[float, ...] = (0.8, 0.95), drift: bool = True) -> DataFrame:
    """last + h * drift, with intervals z * sigma * sqrt(h)."""
    d = series.withColumn("d", F.col(value) - F.lag(value).over(by(*keys)))
    g = d.groupBy(*keys).agg(F.max_by(value, "date").alias("last"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("drift"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("sigma"))
    if not drift:
        g = d.groupBy(*keys).agg(F.max_by(value, "date").alias("last"), F.lit(0.0).alias("drift"), F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("sigma"))
    g = g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("point", F.col("last") + F.col("h") * F.col("drift"))
    for p in levels:
        half = NormalDist().inv_cdf((1 + p) / 2) * F.col("sigma") * F.sqrt("h")
        g = g.withColumn(f"low_{round(p * 100)}", F.col("point") - half).withColumn(f"high_{round(p * 100)}", F.col("point") + half)
    return g.drop("last", "drift", "sigma")


def backtest(series: DataFrame, keys: list[str], horizon: int, origins: int = 5, min_train: int = 100, value: str = "value") -> DataFrame:
    """forecast at each origin against the row `horizon` later; running windows hold every origin's fit.

    Series of min_train + horizon + 1 rows or fewer give no rows.
    """
    w = by(*keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("d", F.col(value) - F.lag(value).over(w)).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    s = s.withColumn("drift", F.avg("d").over(run)).withColumn("sigma", F.stddev_pop("d").over(run)).withColumn("actual", F.lead(value, horizon).over(w))
    a, b = F.lit(min_train), F.col("n") - horizon - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda k: F.floor(a + (b - a) * k / max(1, origins - 1)))
    s = s.where((F.col("n") > min_train + horizon + 1) & F.array_contains(at, F.col("i").cast("long")))
    point = F.col(value) + horizon * F.col("drift")
    out = s.withColumn("point", point)
    for p in (0.8, 0.95):
        half = NormalDist().inv_cdf((1 + p) / 2) * F.col("sigma") * horizon**0.5
        out = out.withColumn(f"in_{round(p * 100)}", (F.col("actual") >= F.col("point") - half) & (F.col("actual") <= F.col("point") + half))
    return out.select(*keys, "date", "i", "point", "actual", "in_80", "in_95")


def backtest_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("actual") - F.col("point")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_origins"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.col("in_80").cast("double")).alias("coverage_80"), F.avg(F.col("in_95").cast("double")).alias("coverage_95"))


def adaptive_plan(lengths: DataFrame, horizon: int, origins: int = 5, min_train: int = 252, least: int = 30) -> DataFrame:
    """training size and origins that fit a series of n rows; no origins under `least` training rows."""
    room = F.col("n") - horizon - 1
    train = F.least(F.lit(min_train), F.greatest(F.lit(least), F.floor(room / 2)))
    return lengths.withColumn("min_train", train).withColumn("n_origins", F.when(room < least, 0).otherwise(F.least(F.lit(origins), room - train + 1)))


def agreement(rows: DataFrame) -> DataFrame:
    """of (point, p5, p25, p75, p95)."""
    p = F.col("point")
    return rows.withColumn("verdict", F.when(p.between(F.col("p25"), F.col("p75")), "agree").when((p < F.col("p5")) | (p > F.col("p95")), "disagree").otherwise("moderate"))


def forecast_with(series: DataFrame, keys: list[str], fit: Callable, schema: str) -> DataFrame:
    """a caller's model, fitted to each series on its own; a series must fit one task's memory."""
    return series.groupBy(*keys).applyInPandas(fit, schema)


def terminal_values(paths: DataFrame, keys: list[str]) -> DataFrame:
    return paths.groupBy(*keys, "path_id").agg(F.max_by("value", "step").alias("v"), F.min_by("value", "step").alias("s0"))


def path_summary(paths: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """Bands of terminal values, chances of loss and of a 10 % gain, VaR and shortfall."""
    t = terminal_values(paths, keys).withColumn("ret", ratio(F.col("v"), F.col("s0")) - 1)
    t = staged(t, "terminal")
    bands = percentiles(t, keys, "v", {f"p{q}": q / 100 for q in (5, 25, 50, 75, 95)})
    var = percentiles(t, keys, "ret", {"var": 1 - confidence}).withColumn("var", -F.col("var"))
    a = t.groupBy(*keys).agg(F.avg((F.col("v") < F.col("s0")).cast("double")).alias("p_loss"), F.avg((F.col("v") > F.col("s0") * 1.1).cast("double")).alias("p_gain_10"))
    a = bands.join(a, keys).join(var, keys)
    short = t.join(a.select(*keys, "var"), keys).groupBy(*keys).agg((-F.avg(F.when(F.col("ret") <= -F.col("var"), F.col("ret")))).alias("shortfall"))
    return a.join(short, keys)


def path_drawdowns(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, 5th percentile and worst of the paths' deepest falls."""
    w = by(*keys, "path_id", order="step").rowsBetween(Window.unboundedPreceding, 0)
    d = paths.withColumn("peak", F.max("value").over(w)).withColumn("dd", ratio(F.col("value") - F.col("peak"), F.col("peak")))
    each = d.groupBy(*keys, "path_id").agg(F.min("dd").alias("dd"))
    each = staged(each, "falls")
    g = each.groupBy(*keys).agg(F.avg("dd").alias("mean_dd"), F.min("dd").alias("worst_dd"))
    return g.join(percentiles(each, keys, "dd", {"median_dd": 0.5, "p5_dd": 0.05}), keys).select(*keys, "mean_dd", "median_dd", "p5_dd", "worst_dd")
