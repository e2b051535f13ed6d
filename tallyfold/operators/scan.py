"""Prefix scans and order statistics of groups of any size, in range-partitioned blocks.

A plain window puts a whole group into one task. Here rows are sorted by group and order over all tasks; each
block (a partition's part of a group) is scanned by itself, and what the blocks before it leave is carried in:
one row for each block that does not begin its group, so at most one for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.sources.shared import staged

PART = "__part"


def dealt(rows: DataFrame, keys: list[str], order: list[Column], name: str = "dealt") -> DataFrame:
    """`rows` in ranges of keys and order, with the number of each row's range; written once, as ranges must not change between uses."""
    return staged(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), name)


def prefix(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, name: str = "prefix") -> DataFrame:
    """Adds running sums and last known (non-null) values, from each key's first row up to each row.

    sums and lasts: new column -> column. Equal to a window of rows from the key's start; rows of equal order
    come in any order, as there. Null keys are a key.
    """
    sums, lasts = sums or {}, lasts or {}
    d = dealt(rows, keys, order, name)
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = d.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in lasts.items()])
    # Of a block only its last row's values go on; keys that lie in one block have nothing to carry.
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    spread = d.groupBy(*named).agg(F.min(PART).alias("__a"), F.max(PART).alias("__b")).where("__a < __b").drop("__a", "__b")
    wide = d.join(F.broadcast(spread), same, "left_semi") if keys else d  # fewer keys than ranges
    last = [F.last(c, ignorenulls=True).over(block).alias(f"__{n}") for n, c in lasts.items()]
    ends = wide.select(PART, *keys, *[c for c in dict.fromkeys(sums.values())], *last).groupBy(PART, *keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], *[F.first(f"__{n}").alias(f"__{n}") for n in lasts], F.count("*").alias("__rows"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(PART).alias("__p"), *named, *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums], *[F.last(f"__{n}", ignorenulls=True).over(before).alias(f"__{n}") for n in lasts], F.count("*").over(before).alias("__before")).where("__before > 0")
    j = local.join(F.broadcast(carried), (F.col(PART) == F.col("__p")) & same, "left")
    added = lambda n: F.when(F.col(f"__{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"__{n}")).otherwise(F.col(n) + F.col(f"__{n}"))
    return j.select(*rows.columns, *[added(n).alias(n) for n in sums], *[F.coalesce(n, f"__{n}").alias(n) for n in lasts])


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and one column for each wanted percentile (0 to 1) of a group's non-null values, exact and linear between ranks.

    Values are counted first, so that ties are one row; ranks are running sums over ranges of values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = staged(prefix(counts, keys, [F.col("__v")], {"__upto": "__n"}, name="ranks"), "ranked")
    n = ranked.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.sum("__n").alias("__total"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    j = ranked.join(n, same) if keys else ranked.crossJoin(F.broadcast(n))
    picked = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("__total") - 1)
        holds = lambda rank: (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))
        low, high = F.floor(at), F.ceil(at)
        picked.append((name, at, F.max(F.when(holds(low), F.col("__v"))).alias(f"__low_{name}"), F.max(F.when(holds(high), F.col("__v"))).alias(f"__high_{name}")))
    g = j.groupBy(*keys).agg(F.max("__total").alias("__total"), *[c for p in picked for c in p[2:]])
    between = lambda name, at: F.when(F.floor(at) == F.ceil(at), F.col(f"__low_{name}")).otherwise((F.ceil(at) - at) * F.col(f"__low_{name}") + (at - F.floor(at)) * F.col(f"__high_{name}"))
    return g.select(*keys, *[between(name, at).alias(name) for name, at, _, _ in picked])
