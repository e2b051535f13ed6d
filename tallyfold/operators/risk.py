"""Risk of daily return series, for all entities at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.stats import annual_vol, by, downside_vol, parametric_var, ratio, sharpe, sortino, DAYS
from tallyfold.operators.scan import percentiles


BLOCK_ASSETS, SPANS = 256, 64  # assets of a block and spans of dates in correlations


def summary(returns: DataFrame, keys: list[str], rf: float = 0.07, confidence: float = 0.95, r: str = "r") -> DataFrame:
    """R1-R4 and R8 in one aggregate, R7 by ranks over ranges of returns."""
    known = returns.where(F.col(r).isNotNull())
    g = known.groupBy(*keys).agg(annual_vol(r).alias("volatility"), downside_vol(r).alias("downside"), sharpe(r, rf).alias("sharpe"), sortino(r, rf).alias("sortino"), parametric_var(r, confidence).alias("var_param"))
    return g.join(historical_var(known, keys, confidence, r), keys).select(*keys, "volatility", "downside", "sharpe", "sortino", "var_hist", "var_param")


def historical_var(returns: DataFrame, keys: list[str], confidence: float = 0.95, r: str = "r") -> DataFrame:
    """Keys, var_hist: the loss at an exact percentile of the returns, linear between ranks."""
    return percentiles(returns, keys, r, {"var_hist": 1 - confidence}).withColumn("var_hist", -F.col("var_hist"))


def beta_alpha(returns: DataFrame, benchmark: DataFrame, keys: list[str], rf: float = 0.0) -> DataFrame:
    """Of excess returns on common dates; null under two dates or at zero variance."""
    j = returns.join(benchmark, "date").where("r is not null and b is not null")
    p, b = F.col("r") - rf / DAYS, F.col("b") - rf / DAYS
    g = j.withColumn("p", p).withColumn("q", b).groupBy(*keys).agg(ratio(F.covar_samp("p", "q"), F.var_samp("q")).alias("beta"), F.avg("p").alias("mp"), F.avg("q").alias("mq"))
    return g.select(*keys, "beta", ((F.col("mp") - F.col("beta") * F.col("mq")) * DAYS).alias("alpha"))


def drawdowns(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running peak and fall from it on each day."""
    w = by(*keys).rowsBetween(Window.unboundedPreceding, 0)
    v = values.withColumn("peak", F.max(value).over(w))
    return v.withColumn("drawdown", ratio(F.col(value) - F.col("peak"), F.col("peak")))


def max_drawdown(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Deepest fall, its peak, trough and recovery dates, and days to recovery or to the last date."""
    d = drawdowns(values, keys, value)
    low = d.groupBy(*keys).agg(F.min_by(F.struct("drawdown", F.col("date").alias("trough"), F.col("peak").alias("top")), F.struct("drawdown", "date")).alias("x"), F.max("date").alias("last")).select(*keys, "x.*", "last")
    j = d.join(low.withColumnRenamed("drawdown", "depth"), keys)
    e = j.groupBy(*keys).agg(F.first("depth").alias("max_drawdown"), F.first("trough").alias("trough"), F.first("last").alias("last"), F.max(F.when((F.col("date") <= F.col("trough")) & (F.col(value) == F.col("top")), F.col("date"))).alias("peak_date"), F.min(F.when((F.col("date") > F.col("trough")) & (F.col(value) >= F.col("top")), F.col("date"))).alias("recovery"))
    return e.select(*keys, "max_drawdown", "peak_date", "trough", "recovery", F.datediff(F.coalesce("recovery", "last"), "peak_date").alias("days"))


def conditional_var(returns: DataFrame, keys: list[str], confidence: float = 0.95, r: str = "r") -> DataFrame:
    """Mean loss at or beyond the historical threshold."""
    t = historical_var(returns, keys, confidence, r)
    return returns.join(t, keys).groupBy(*keys).agg((-F.avg(F.when(F.col(r) <= -F.col("var_hist"), F.col(r)))).alias("cvar"))


def correlations(returns: DataFrame, group: list[str], asset: str, r: str = "r") -> DataFrame:
    """Pairwise-complete correlations in long form, each pair once; null at zero variance.

    Assets are dealt into blocks by hash and dates into spans. A task holds a span's returns of two blocks as
    matrices and gives the co-moments of all their pairs by matrix products, centred in the task; the spans'
    co-moments are then merged pair by pair. A date's pairs are thus shared out over all pairs of blocks. An
    asset with two returns on a date has each paired with each, as in a join.
    """
    x = returns.where(F.col(r).isNotNull()).select(*group, "date", F.col(asset).alias("__asset"), F.col(r).cast("double").alias("__x"))
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy(*group, "date", "__asset").orderBy("__x")))  # repeated returns
    blocks = -(-max(1, x.agg(F.count_distinct("__asset")).first()[0]) // BLOCK_ASSETS)
    x = x.withColumn("__b", F.pmod(F.xxhash64("__asset"), F.lit(blocks)).cast("int")).withColumn("__span", F.pmod(F.xxhash64("date"), F.lit(SPANS)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = x.withColumn("__o", other).withColumn("__p", F.least("__b", "__o")).withColumn("__q", F.greatest("__b", "__o"))
    kinds = dict(x.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", " * bool(group) + f"a {kinds['__asset']}, b {kinds['__asset']}, n long, ma double, mb double, saa double, sbb double, sab double"

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.assign(__row=pdf["date"].astype(str) + "/" + pdf["__i"].astype(str))
        p, q = pdf["__p"].iloc[0], pdf["__q"].iloc[0]
        at = [wide[wide["__b"] == k].pivot(index="__row", columns="__asset", values="__x") for k in (p, q)]
        rows = at[0].index.union(at[1].index)
        values = [m.reindex(rows).to_numpy(float) for m in at]
        known = [~np.isnan(v) for v in values]
        values = [np.where(k, v, 0.0) for v, k in zip(values, known, strict=True)]
        (va, vb), (ka, kb) = values, [k.astype(float) for k in known]
        # centred by each asset's own mean first, so that little cancels
        ca, cb = (v.sum(0) / np.maximum(k.sum(0), 1) for v, k in ((va, ka), (vb, kb)))
        va, vb = np.where(ka > 0, va - ca, 0), np.where(kb > 0, vb - cb, 0)
        n, sa, sb = ka.T @ kb, va.T @ kb, ka.T @ vb
        saa, sbb, sab = (va * va).T @ kb, ka.T @ (vb * vb), va.T @ vb
        i, j = np.nonzero(n > 0)
        a, b = at[0].columns.to_numpy()[i], at[1].columns.to_numpy()[j]
        n, sa, sb, saa, sbb, sab = (m[i, j] for m in (n, sa, sb, saa, sbb, sab))
        out = pd.DataFrame({**{g: pdf[g].iloc[0] for g in group}, "a": a, "b": b, "n": n.astype("int64"), "ma": sa / n + ca[i], "mb": sb / n + cb[j], "saa": saa - sa * sa / n, "sbb": sbb - sb * sb / n, "sab": sab - sa * sb / n})
        swap = out["a"] > out["b"]
        out.loc[swap, ["a", "b", "ma", "mb", "saa", "sbb"]] = out.loc[swap, ["b", "a", "mb", "ma", "sbb", "saa"]].to_numpy()
        return out if p != q else out[(at[0].columns.get_indexer(a) <= at[1].columns.get_indexer(b))]

    m = x.groupBy(*group, "__span", "__p", "__q").applyInPandas(moments, schema)
    n, da, db = F.col("n"), F.col("ma") - F.col("__ma"), F.col("mb") - F.col("__mb")
    pair = Window.partitionBy(*group, "a", "b")
    mean = lambda c: F.sum(n * F.col(c)).over(pair) / F.sum("n").over(pair)
    m = m.withColumn("__ma", mean("ma")).withColumn("__mb", mean("mb"))
    g = m.groupBy(*group, "a", "b").agg(F.sum(F.col("saa") + n * da * da).alias("saa"), F.sum(F.col("sbb") + n * db * db).alias("sbb"), F.sum(F.col("sab") + n * da * db).alias("sab"), F.sum("n").alias("n"))
    return g.select(*group, "a", "b", F.when(F.col("n") > 1, ratio(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb")))).alias("corr"), "n")


def in_window(series: DataFrame, keys: list[str], start: str | None = None, end: str | None = None, least: int = 3) -> DataFrame:
    """The rows of [start, end], of keys that have at least `least` there; start must be before end."""
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("date") <= F.lit(end).cast("date"))
    n = F.count("*").over(Window.partitionBy(*keys))
    return series.where(inside).withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def report(series: DataFrame, benchmark: DataFrame, keys: list[str], value: str = "value", rf: float = 0.07, confidence: float = 0.95, start: str | None = None, end: str | None = None) -> DataFrame:
    """All measures R1-R9 of each value series within a window, one row for each key.

    series: keys, date, value (R11); benchmark: date, b. Portfolios with under three rows are left out.
    """
    s = in_window(series, keys, start, end)
    w = by(*keys)
    x = s.withColumn("r", ratio(F.col(value), F.lag(value).over(w)) - 1)
    span = s.groupBy(*keys).agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"))
    x = x.where("r is not null")
    return span.join(summary(x, keys, rf, confidence), keys).join(conditional_var(x, keys, confidence), keys).join(beta_alpha(x, benchmark, keys, rf), keys, "left").join(max_drawdown(s, keys, value), keys)


def current_holdings_series(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Value of today's holdings over all dates on which every held symbol was priced.

    weights: portfolio, symbol, mv of the last day; prices: symbol, date, close.
    """
    held = weights.where("mv > 1e-9")
    n = held.groupBy("portfolio").agg(F.count("*").alias("n_held"))
    last = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("last"))
    j = held.join(prices, "symbol").join(last, "symbol").groupBy("portfolio", "date").agg(F.sum(F.col("mv") * F.col("close") / F.col("last")).alias("value"), F.count("*").alias("n"))
    return j.join(n, "portfolio").where("n = n_held").select("portfolio", "date", "value")
