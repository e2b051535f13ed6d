"""Returns, cash flows and money-weighted results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.stats import annualized, by, cagr, compounded, ratio


def capital_summary(rows: DataFrame) -> DataFrame:
    """Of (portfolio, mv, invested, realized_pnl, deployed): absolute and relative gain."""
    gain = F.col("mv") - F.col("invested")
    closed = (F.abs("invested") < 1e-9) & (F.col("deployed") > 0)
    return rows.select("portfolio", F.when(closed, F.col("realized_pnl")).otherwise(gain).alias("absolute"), F.when(closed, ratio(F.col("realized_pnl"), F.col("deployed"))).otherwise(ratio(gain, F.col("invested"))).alias("relative"))


def growth(navs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First and last value, CAGR, total return and its annual rate."""
    g = navs.groupBy(*keys).agg(F.min_by(value, "date").alias("v0"), F.max_by(value, "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    total = ratio(F.col("v1"), F.col("v0")) - 1
    return g.select(*keys, "v0", "v1", "days", cagr(F.col("v0"), F.col("v1"), F.col("days")).alias("cagr"), annualized(total, F.col("days")).alias("annualized"))


def periodic_returns(returns: DataFrame, keys: list[str], freq: str, r: str = "r") -> DataFrame:
    """P5: product per week (labelled by its Sunday), month or year (by its last day); empty periods give 0."""
    unit = {"W": "week", "ME": "month", "YE": "year"}[freq]
    last = {"W": F.date_add(F.col("p"), 6), "ME": F.last_day("p"), "YE": F.make_date(F.year("p"), F.lit(12), F.lit(31))}[freq]
    p = F.trunc("date", unit)
    span = returns.groupBy(*keys).agg(F.min(p).alias("a"), F.max(p).alias("b")).select(*keys, F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("p"))
    got = returns.groupBy(*keys, p.alias("p")).agg(compounded(r).alias("x"))
    return span.join(got, [*keys, "p"], "left").select(*keys, last.alias("period_end"), F.coalesce("x", F.lit(0.0)).alias("ret"))


def rolling_returns(returns: DataFrame, keys: list[str], n: int, r: str = "r") -> DataFrame:
    """Compounded over n rows; null until there are n."""
    w = by(*keys).rowsBetween(-(n - 1), 0)
    return returns.withColumn("rolling", F.when(F.count(r).over(w) == n, F.product(1 + F.col(r)).over(w) - 1))


def flow_returns(values: DataFrame, flows: DataFrame, keys: list[str], value: str = "mv") -> DataFrame:
    """(V - V before - flow) / V before; null unless V before is positive."""
    v = values.join(flows, [*keys, "date"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    before = F.lag(value).over(by(*keys))
    return v.withColumn("r", (F.col(value) - before - F.col("flow")) / F.when(before > 0, before))


def trade_flows(ledger: DataFrame) -> DataFrame:
    """Per day bought for, with fees, less what sells brought."""
    gross = F.col("price") * F.col("qty")
    return ledger.groupBy("portfolio", "date").agg(F.sum(F.when(F.col("kind") == "BUY", gross + F.col("fees")).when(F.col("kind") == "SELL", -(gross - F.col("fees") - F.col("tax"))).otherwise(0.0)).alias("flow"))


def implied_flows(marked: DataFrame) -> DataFrame:
    """Change of quantity at the day's unit value, or the day before's if all was sold; summed per day."""
    w = by("portfolio", "symbol")
    q0, v0 = F.lag("qty", 1, 0.0).over(w), F.lag("mv", 1, 0.0).over(w)
    m = marked.withColumn("q0", q0).withColumn("v0", v0)
    unit = F.when(F.col("qty") > 1e-9, ratio(F.col("mv"), F.col("qty"))).otherwise(ratio(F.col("v0"), F.col("q0")))
    d = F.col("qty") - F.col("q0")
    return m.groupBy("portfolio", "date").agg(F.sum(F.when(F.abs(d) <= 1e-9, 0.0).otherwise(F.coalesce(d * unit, F.lit(0.0)))).alias("flow"))


def time_weighted(returns: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """P10."""
    return returns.groupBy(*keys).agg(compounded(r).alias("twr"))


def investor_flows(ledger: DataFrame, values: DataFrame) -> DataFrame:
    """What the investor paid (-) and got (+) per day, and the last market value."""
    k, gross = F.col("kind"), F.col("price") * F.col("qty")
    cf = F.when(k == "BUY", -(gross + F.col("fees"))).when(k == "SELL", gross - F.col("fees") - F.col("tax")).when(k == "DIVIDEND", F.col("price"))
    end = values.groupBy("portfolio").agg(F.max("date").alias("date"), F.max_by("mv", "date").alias("cf"))
    return ledger.select("portfolio", "date", cf.alias("cf")).where("cf is not null").unionByName(end).groupBy("portfolio", "date").agg(F.sum("cf").alias("cf"))


def xirr(flows: DataFrame, steps: int = 80, low: float = -0.9999, high: float = 10.0) -> DataFrame:
    """Root of sum cf / (1 + r)^(days / 365) by bisection, one per portfolio; null without a sign change.

    Flows are summed per day first, so a portfolio's array is bounded by its days.
    """
    first = Window.partitionBy("portfolio")
    f = flows.withColumn("t", F.datediff("date", F.min("date").over(first)) / 365.0)
    g = f.groupBy("portfolio").agg(F.collect_list(F.struct("t", "cf")).alias("f"), F.count("*").alias("n"))
    at = lambda r: f"aggregate(f, 0D, (s, x) -> s + x.cf / pow(1 + {r}, x.t))"
    step = f"if({at('(a.lo + a.hi) / 2')} * a.v > 0, named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi, 'v', a.v), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2, 'v', a.v))"
    g = g.withColumn("va", F.expr(at(f"({low}D)"))).withColumn("vb", F.expr(at(f"({high}D)")))
    root = F.expr(f"aggregate(sequence(1, {steps}), named_struct('lo', {low}D, 'hi', {high}D, 'v', va), (a, i) -> {step}, a -> (a.lo + a.hi) / 2)")
    return g.select("portfolio", F.when((F.col("n") >= 2) & (F.col("va") * F.col("vb") <= 0), root).alias("xirr"))
