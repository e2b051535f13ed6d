"""Ledger, price and run-log sources and sinks over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators.validation import COLUMNS


def read_ledger_csv(spark: SparkSession, path: str, portfolio: str) -> DataFrame:
    """All columns as text, blanks kept, rows in file order; a missing column is an error that names it."""
    header = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    if missing := [c for c in COLUMNS if c not in header]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in header)
    df = spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path).na.fill("", COLUMNS)
    return df.select(F.lit(portfolio).alias("portfolio"), F.monotonically_increasing_id().alias("row_idx"), *COLUMNS)


def read_prices(prices: DataFrame, tickers: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted tickers in [start, end], and the wanted tickers without any."""
    rows = prices.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(tickers.select("symbol").distinct(), "symbol", "left_semi")
    return rows, tickers.select("symbol").distinct().join(rows, "symbol", "left_anti")


def read_splits(splits: DataFrame, start: str, end: str) -> DataFrame:
    """S3."""
    return splits.where(F.col("split_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_prices(prices: DataFrame, path: str) -> None:
    """Dealt by ranges of symbol and date and sorted, so readers of one symbol skip most row groups and no symbol is one task."""
    prices.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(path)


def read_price_cache(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """The cached prices, all or of some symbols; the symbol filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def replace_history(ledger: DataFrame, path: str) -> None:
    """An upload replaces its portfolios' whole history; portfolios it does not name, and so an empty upload, change nothing."""
    ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("portfolio").parquet(path)


def delete_portfolios(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """S10, of one table."""
    return rows.join(gone.select("portfolio").distinct(), "portfolio", "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table that names portfolios, facts and dimension alike, without those in `gone`."""
    return {name: delete_portfolios(rows, gone) for name, rows in tables.items()}


def absent(gone: DataFrame, portfolios: DataFrame) -> DataFrame:
    """The names to delete that no portfolio has."""
    return gone.select("portfolio").distinct().join(portfolios.select("portfolio"), "portfolio", "left_anti")


def register(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Ids for new names, from the largest id on, in name order. Registration batches are small by nature."""
    top = existing.agg(F.coalesce(F.max("portfolio_id"), F.lit(0)).alias("top"))
    new = names.select("portfolio").distinct().join(existing, "portfolio", "left_anti")
    return new.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("portfolio"))).cast("long").alias("portfolio_id"), "portfolio")


def fold_runs(log: DataFrame) -> DataFrame:
    """One row per run from its start and finish events; the error keeps its last 8000 characters."""
    started = F.min(F.when(F.col("status") == "RUNNING", F.col("at")))
    ended = F.max(F.when(F.col("status") != "RUNNING", F.col("at")))
    g = log.groupBy("run_id").agg(F.max_by("status", F.struct("at", F.col("status") != "RUNNING")).alias("status"), started.alias("started_at"), ended.alias("completed_at"), F.max("rows_processed").alias("rows_processed"), F.max("error").alias("error"))
    return g.withColumn("duration_seconds", F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))).withColumn("error", F.expr("right(error, 8000)"))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """S13."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
