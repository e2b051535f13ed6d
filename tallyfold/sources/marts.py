"""Stored marts and fact tables: Parquet in folders by key bucket and month, read pruned, merged by copy-on-write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfold.operators.temporal import pick_one
from tallyfold.sources.shared import staged

BUCKETS = 4  # of keys within a month


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def placed(rows: DataFrame, key: str, date: str) -> DataFrame:
    """`rows` with the folders that they belong into."""
    return rows.withColumn("bucket", _bucket(F.col(key))).withColumn("month", F.date_format(date, "yyyy-MM"))


def write(rows: DataFrame, path: str, key: str, date: str) -> None:
    """Replaces the folders that `rows` fall into, and no others, so a refresh names just its months.

    Rows meet by folder; adaptive execution parts a folder that is too large for one file. Within a file rows
    are sorted, so readers of one key also skip row groups.
    """
    _replace(placed(rows, key, date).hint("rebalance", "bucket", "month").sortWithinPartitions("bucket", "month", key, date), path)


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "month").parquet(path)


def read(spark: SparkSession, path: str, key: str, date: str, schema: StructType | None = None, value: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The stored rows of one key (or all), from `start` to `end` (dates as text); other folders are not opened."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if value is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(value))) & (F.col(key) == value))
    if start is not None:
        rows = rows.where((F.col("month") >= start[:7]) & (F.col(date) >= F.lit(start).cast("date")))
    if end is not None:
        rows = rows.where((F.col("month") <= end[:7]) & (F.col(date) <= F.lit(end).cast("date")))
    return rows.drop("bucket", "month")


def merge(batch: DataFrame, path: str, key: str, date: str, natural: list[str], version: str) -> int:
    """The batch's rows go into the stored table; returns how many folders were written anew.

    Of rows with equal `natural` columns (key and date among them) the one with the latest version stays, of
    equal versions the batch's. Only folders in which that changes a row are read whole and rewritten: merged
    rows are staged first and then replace the folders, so a merge that fails leaves the old rows, and one
    that is repeated writes nothing.
    """
    spark = batch.sparkSession
    new = staged(placed(pick_one(batch, natural, [F.desc(version)]), key, date), "batch")
    folders = new.select("bucket", "month").distinct()
    stored = spark.read.schema(new.schema).parquet(path)
    touched = stored.join(F.broadcast(folders), ["bucket", "month"], "left_semi").select(*new.columns)  # prunes at run time
    both = touched.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    merged = staged(pick_one(both, natural, [F.desc(version), F.desc("__new")]), "merged")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in new.columns]
    fresh = merged.where("__new = 1").drop("__new").alias("n")
    changed = fresh.join(touched.alias("o"), same, "left_anti").select("bucket", "month").distinct()
    changed = staged(changed, "changed")
    _replace(merged.drop("__new").join(F.broadcast(changed), ["bucket", "month"], "left_semi").select(*new.columns), path)
    return changed.count()
