"""Oversell rejection, positions, weighted-average cost, cash and net asset value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.temporal import carry

EPS = 1e-9
FALL = 230.0  # natural logarithm of 1e100: how far a product of factors may fall within a block
KEY = ["portfolio", "symbol"]


def mark_oversold(trades: DataFrame, keys: list[str] = KEY, order: tuple[str, ...] = ("date", "row_idx")) -> DataFrame:
    """V8: adds `rejected`: sells of more than is held at that point; a rejected sell changes nothing.

    Until a position's running quantity first falls below zero nothing is rejected, which a window finds; rows
    before that stay in the JVM. Only from there on is a position walked trade by trade, as the fold is not
    linear: those rows stream through one state, in the tasks and order into which the window has dealt them.
    """
    names = trades.columns
    at = {n: i for i, n in enumerate([*names, "__run"])}
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("kind") == "BUY", F.col("qty")).when(F.col("kind") == "SELL", -F.col("qty")).otherwise(0.0)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = 0.0, None
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            columns = [b.column(at[c]).to_pylist() for c in (*keys, "kind", "qty", "__run")]
            for i, (*k, kind, q, run) in enumerate(zip(*columns, strict=True)):
                if k != last:  # the sell at which the position first falls below zero
                    held, last = run + q, k
                bad = kind == "SELL" and q > held + EPS
                if kind == "BUY":
                    held += q
                elif kind == "SELL" and not bad:
                    held -= q
                out[i] = bad
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*names, "rejected"])

    low = trades.withColumn("__run", F.sum(signed).over(w)).withColumn("__low", F.min("__run").over(w))
    fine = low.where(F.coalesce(F.col("__low") >= -EPS, F.lit(True))).select(*names, F.lit(False).alias("rejected"))
    below = low.where(F.col("__low") < -EPS).select(*names, "__run").sortWithinPartitions(*keys, *order)
    return fine.unionByName(below.mapInArrow(walk, ", ".join(f"`{n}` {t}" for n, t in trades.dtypes) + ", rejected boolean"))


def accepted(trades: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return mark_oversold(trades, keys).where("not rejected").drop("rejected")


def moves(ledger: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """H1: per position and day bought quantity, cost of buys with fees, sold quantity."""
    buy = F.col("kind") == "BUY"
    zero = F.lit(0.0)
    return ledger.where(F.col("kind").isin("BUY", "SELL")).groupBy(*keys, "date").agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(zero)).alias("buy_qty"), F.sum(F.when(buy, F.col("price") * F.col("qty") + F.col("fees")).otherwise(zero)).alias("buy_cost"), F.sum(F.when(~buy, F.col("qty")).otherwise(zero)).alias("sell_qty")
    )


def positions(day_moves: DataFrame, keys: list[str] = KEY, also: tuple[str, ...] = ()) -> DataFrame:
    """H2, H3: qty and weighted-average remaining cost after each day with moves; columns `also` stay.

    Each day is an affine map, cost -> cost * factor + bought, and a prefix of them is one again. A full exit
    (factor 0) starts a segment. A segment falls into blocks, each of them as long as the product of its
    factors, A, stays above 1e-100: within a block cost = A * (carried + sum(bought / A)), so nothing is
    divided by a product that vanishes, however many partial sells there are. What a block carries on is its
    last cost; of the block before it, under 1e-100 of that is left, which no double can tell from nothing.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    m = day_moves.withColumn("qty", F.sum(F.col("buy_qty") - F.col("sell_qty")).over(run))
    m = m.withColumn("q0", F.coalesce(F.lag("qty").over(w), F.lit(0.0))).withColumn("s0", F.least("sell_qty", "q0"))
    m = m.withColumn("factor", F.when(F.col("q0") - F.col("s0") <= EPS, 0.0).otherwise(1 - F.col("s0") / F.when(F.col("q0") > 0, F.col("q0"))))
    m = m.withColumn("bought", F.when(F.col("buy_qty") > 0, F.col("buy_cost") * (1 - (F.col("sell_qty") - F.col("s0")) / F.when(F.col("buy_qty") > 0, F.col("buy_qty")))).otherwise(0.0))
    m = m.withColumn("segment", F.sum((F.col("factor") == 0).cast("int")).over(run))
    m = m.withColumn("block", F.floor(F.sum(F.when(F.col("factor") > 0, -F.ln("factor")).otherwise(0.0)).over(run) / FALL))
    in_block = Window.partitionBy(*keys, "segment", "block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("a", F.product(F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor"))).over(in_block))
    m = m.withColumn("cost", F.col("a") * F.sum(F.col("bought") / F.col("a")).over(in_block))
    m = m.withColumn("before", F.when(F.lag("segment").over(w) == F.col("segment"), F.lag("cost").over(w)))
    carried = F.coalesce(F.first("before").over(in_block), F.lit(0.0))
    return m.select(*keys, "date", "qty", (F.col("cost") + F.col("a") * carried).alias("cost"), *also)


def daily_cube(held: DataFrame, until, keys: list[str] = KEY, since=None) -> DataFrame:
    """H4: each position's state on every day from its first move (and `since`, if given) to `until`."""
    return carry(held, keys, "date", until, ["qty", "cost"], since)


def net_invested_cube(ledger: DataFrame, until, keys: list[str] = KEY) -> DataFrame:
    """H5: running signed quantity and running buys less sale proceeds, carried to every day."""
    buy = F.col("kind") == "BUY"
    d = ledger.groupBy(*keys, "date").agg(F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("dq"), F.sum(F.when(buy, F.col("price") * F.col("qty")).otherwise(-F.col("price") * F.col("qty"))).alias("dc"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = d.select(*keys, "date", F.sum("dq").over(w).alias("qty"), F.sum("dc").over(w).alias("net_invested"))
    return carry(run, keys, "date", until, ["qty", "net_invested"])


def mark_to_market(cube: DataFrame, prices: DataFrame, until, since=None) -> DataFrame:
    """M1: cube rows with the last close and market value; 0 where never priced.

    Closes are carried to every day once, by symbol; the cube then meets them by symbol and day, so no
    symbol's positions stand in one task.
    """
    m = cube.join(carry(prices, ["symbol"], "date", until, ["close"], since), ["symbol", "date"], "left")
    return m.withColumn("mv", F.col("qty") * F.coalesce("close", F.lit(0.0)))


def fill_gaps(marked: DataFrame) -> DataFrame:
    """`value` is the market value, or the cost where something is held and has no value."""
    return marked.withColumn("value", F.when((F.col("qty") > 0) & (F.abs("mv") < EPS), F.col("cost")).otherwise(F.col("mv")))


def cash_delta(ledger: DataFrame) -> DataFrame:
    """K1: per portfolio and day cash in less cash out; buys are funded from outside."""
    k, p = F.col("kind"), F.col("price")
    d = F.when(k == "SELL", p * F.col("qty") - F.col("fees") - F.col("tax")).when(k.isin("DIVIDEND", "DEPOSIT"), p).when(k == "WITHDRAWAL", -p).otherwise(0.0)
    return ledger.groupBy("portfolio", "date").agg(F.sum(d).alias("delta"))


def running_cash(deltas: DataFrame) -> DataFrame:
    """K2."""
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("portfolio", "date", F.sum("delta").over(w).alias("balance"))


def nav(marked: DataFrame, cash: DataFrame, until, since=None) -> DataFrame:
    """Market value, cost, carried cash and net asset value by portfolio and day up to `until`."""
    day = marked.groupBy("portfolio", "date").agg(F.sum("mv").alias("mv"), F.sum("cost").alias("cost"))
    n = day.join(carry(cash, ["portfolio"], "date", until, ["balance"], since), ["portfolio", "date"], "left").withColumn("cash", F.coalesce("balance", F.lit(0.0))).drop("balance")
    return n.withColumn("nav", F.col("mv") + F.col("cash"))


def nav_returns(navs: DataFrame, value: str = "nav") -> DataFrame:
    """Change over the absolute value before; null at the start or after 0."""
    before = F.lag(value).over(Window.partitionBy("portfolio").orderBy("date"))
    return navs.withColumn("r", (F.col(value) - before) / F.nullif(F.abs(before), F.lit(0.0)))


def inception_returns(navs: DataFrame, value: str = "nav") -> DataFrame:
    """Daily and since-inception returns, each null unless its base is positive."""
    w = Window.partitionBy("portfolio").orderBy("date")
    before, first = F.lag(value).over(w), F.first(value).over(w)
    positive = lambda x: F.when(x > 0, x)
    return navs.select("portfolio", "date", ((F.col(value) - before) / positive(before)).alias("daily_return"), ((F.col(value) - first) / positive(first)).alias("cumulative_return"))


def realized(ledger: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Realized profit of each sell at average cost, and capital deployed, per portfolio.

    Trades are the moves of a finer calendar (one trade a step, told apart by row_idx), so the same windows give
    the cost before each; they are dealt by position once.
    """
    buy, sell, zero = F.col("kind") == "BUY", F.col("kind") == "SELL", F.lit(0.0)
    p, q = F.col("price"), F.col("qty")
    move = [F.when(buy, q).otherwise(zero).alias("buy_qty"), F.when(buy, p * q + F.col("fees")).otherwise(zero).alias("buy_cost"), F.when(sell, q).otherwise(zero).alias("sell_qty"), F.when(sell, p * q - F.col("fees") - F.col("tax")).alias("proceeds")]
    steps = ledger.where(buy | sell).select(*keys, F.struct("date", "row_idx").alias("date"), *move)
    w = Window.partitionBy(*keys).orderBy("date")
    t = positions(steps, keys, ("buy_cost", "sell_qty", "proceeds")).withColumn("q0", F.lag("qty").over(w)).withColumn("c0", F.lag("cost").over(w))
    gain = F.col("proceeds") - F.coalesce("c0", zero) * F.col("sell_qty") / F.when(F.col("q0") > EPS, F.col("q0"))
    return t.groupBy("portfolio").agg(F.sum(F.coalesce(gain, zero)).alias("realized_pnl"), F.sum("buy_cost").alias("deployed"))
