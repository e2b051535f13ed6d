"""ST1: incremental positions from a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators.holdings import mark_oversold, positions
from tallyfold.sources.shared import staged

STATE = "position string, qty double, cost double, last timestamp"


def advance(state: DataFrame, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of a batch of trades, and the positions' states after it.

    state: position, qty, cost, last (time of the last applied trade). trades: position, event_id, ts, kind,
    qty, price. Trades before a position's last are late, for a replay; sells of more than is held are
    oversold and change nothing; all others are applied in the order of ts and event_id. A position enters
    with its quantity and cost as one opening buy, so nothing is replayed from the past. Outcomes: position,
    event_id, ts, kind, trade_qty, price, outcome, and qty and cost after it where it was applied.
    """
    t = trades.join(state.select("position", F.col("last")), "position", "left")
    late = t.where(F.col("ts") < F.col("last")).drop("last")
    due = staged(t.where(F.coalesce(F.col("ts") >= F.col("last"), F.lit(True))).drop("last"), "due")
    opening = state.join(due.select("position").distinct(), "position", "left_semi").where("qty > 0 or cost <> 0")
    opening = opening.select("position", F.lit(-1).cast("long").alias("event_id"), F.col("last").alias("ts"), F.lit("BUY").alias("kind"), "qty", "cost", F.lit(0).alias("turn"))
    rows = due.select("position", "event_id", "ts", "kind", "qty", (F.col("price") * F.col("qty")).alias("cost"), F.lit(1).alias("turn"), "price").unionByName(opening.withColumn("price", F.lit(0.0)))
    marked = staged(mark_oversold(rows, ["position"], ("turn", "ts", "event_id")), "marked")
    buy, good = F.col("kind") == "BUY", marked.where("not rejected")
    step = good.select("position", F.struct("turn", "ts", "event_id").alias("date"), F.when(buy, F.col("qty")).otherwise(0.0).alias("buy_qty"), F.when(buy, F.col("cost")).otherwise(0.0).alias("buy_cost"), F.when(buy, 0.0).otherwise(F.col("qty")).alias("sell_qty"))
    after = staged(positions(step, ["position"]), "after")
    now = after.groupBy("position").agg(F.max_by(F.struct("qty", "cost", F.col("date.ts").alias("last")), "date").alias("s")).select("position", "s.*")
    kept = state.join(now.select("position"), "position", "left_anti").unionByName(now)
    facts = ("position", "event_id", "ts", "kind", F.col("qty").alias("trade_qty"), "price")
    applied = marked.where("turn = 1 and not rejected").select(*facts, F.lit("applied").alias("outcome")).join(after.select("position", "date.ts", "date.event_id", "qty", "cost"), ["position", "ts", "event_id"])
    none = lambda df, outcome: df.select(*facts, F.lit(outcome).alias("outcome"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("cost"))
    out = applied.unionByName(none(marked.where("turn = 1 and rejected"), "oversold")).unionByName(none(late, "late"))
    return out, kept


def states(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The positions' states after a batch, or after the last one."""
    all_of = spark.read.schema(STATE + ", batch long").parquet(f"{path}/state")
    at = version if version is not None else all_of.agg(F.max("batch")).first()[0]
    return all_of.where(F.col("batch") == at).drop("batch")


def run(trades: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Starts a query that advances the positions stored under `path` with each micro-batch of `trades`.

    Each batch writes its outcomes to out/batch=N/outcome=..., so that oversold trades (the quarantine) and
    late ones (the replay list) are folders of their own, and then the states to state/batch=N. A batch that
    is run again reads the states before it and writes the same folders, so trades count once. What a batch
    holds is bounded by the source's options (maxFilesPerTrigger); nothing of a position is kept in a worker.
    """
    spark = trades.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = states(spark, path, number - 1) if number else spark.createDataFrame([], STATE)
        out, after = advance(before, staged(batch, "trades"))
        out.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/out/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return trades.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger or {"availableNow": True}).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes so far."""
    return spark.read.parquet(f"{path}/out")
