"""Columns and aggregates that the reports share; undefined results are null."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAYS = 252


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def annual_vol(r: str) -> Column:
    """R1."""
    return F.stddev_samp(r) * DAYS**0.5


def downside_vol(r: str, mar: float = 0.0) -> Column:
    """R2."""
    return F.sqrt(F.avg(F.pow(F.least(F.col(r) - mar, F.lit(0.0)), F.lit(2)))) * DAYS**0.5


def sharpe(r: str, rf: float) -> Column:
    """R3."""
    return ratio(F.avg(r) * DAYS - rf, annual_vol(r))


def sortino(r: str, rf: float, mar: float = 0.0) -> Column:
    """R4."""
    return ratio(F.avg(r) * DAYS - rf, downside_vol(r, mar))


def parametric_var(r: str, confidence: float = 0.95) -> Column:
    """R8."""
    return -(F.avg(r) + NormalDist().inv_cdf(1 - confidence) * F.stddev_samp(r))


def compounded(r: str) -> Column:
    """P10: product of 1 + r over non-null r, less 1."""
    return F.product(1 + F.col(r)) - 1


def cagr(start: Column, end: Column, days: Column) -> Column:
    """Null unless start and days are positive."""
    return F.when((start > 0) & (days > 0), F.pow(end / F.when(start > 0, start), 365.25 / F.when(days > 0, days)) - 1)


def annualized(total: Column, days: Column) -> Column:
    """Null unless days are positive and the loss is not total."""
    return F.when((days > 0) & (total > -1), F.pow(1 + total, 365.25 / F.when(days > 0, days)) - 1)


def correlation(a: str, b: str) -> Column:
    """Pearson's, null at zero variance."""
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def full(value: Column, w: WindowSpec, n: int, what: str) -> Column:
    """`value` over w, null until n non-null rows of `what` are there."""
    return F.when(F.count(what).over(w) == n, value)


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def changes(rows: DataFrame, keys: list[str], value: str, out: str = "r") -> DataFrame:
    """value / previous value - 1."""
    return rows.withColumn(out, ratio(F.col(value), F.lag(value).over(by(*keys))) - 1)
