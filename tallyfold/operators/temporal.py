"""Calendars, versioned dimensions, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators.scan import prefix

END_OF_TIME = "9999-12-31"


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from start to end with its calendar attributes."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as full_date")
    d = F.col("full_date")
    iso_dow = F.expr("cast(extract(dow_iso from full_date) as int)")
    return days.select(F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d, F.dayofmonth(d).alias("day_of_month"), iso_dow.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_num"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), (iso_dow < 6).alias("is_trading_day"))


def extend_calendar(existing: DataFrame, start: str, end: str) -> DataFrame:
    """The days of [start, end] that `existing` lacks."""
    return calendar(existing.sparkSession, start, end).join(existing.select("full_date"), "full_date", "left_anti")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tolerance_days: int | None = None, direction: str = "backward", blocked: bool = False) -> DataFrame:
    """Each left row with the values of the right row of its keys nearest in time.

    Both sides are stacked and one window carries the last right row along, so the work is one shuffle and one
    sort, whatever the sides' sizes; no pair of rows is formed. With `blocked`, rows are sorted by key and time
    over all tasks and last rows are carried from range to range (scan.prefix), so that a key may hold all
    rows. Of right rows with equal keys and time the greatest values win. `tolerance_days` limits the
    distance; `direction` is backward or forward. Null keys and times match nothing: such left rows come back
    with nulls, such right rows take no part.
    """
    known = F.col(right_ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    right = right.where(known)
    back = direction == "backward"
    names = left.columns
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(1 if back else 0).alias("__s"), F.struct(*names).alias("__l"), F.lit(None).cast(right.select(F.struct(F.col(right_ts).alias("t"), *values).alias("x")).schema["x"].dataType).alias("__r"))
    r = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0 if back else 1).alias("__s"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(F.col(right_ts).alias("t"), *values).alias("__r"))
    order = [F.col("__t"), F.col("__s"), F.col("__r")] if back else [F.col("__t").desc(), F.col("__s").desc(), F.col("__r")]
    both = l.unionByName(r)
    if blocked:
        both = prefix(both, keys, order, lasts={"__near": "__r"}, name="asof").withColumn("__r", F.col("__near"))
    else:
        both = both.withColumn("__r", F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.where("__l is not null")
    near = F.col("__t").isNotNull() if tolerance_days is None else F.abs(F.datediff("__t", F.col("__r.t"))) <= tolerance_days
    return both.select("__l.*", *[F.when(near, F.col(f"__r.{v}")).alias(v) for v in values])


def densify(rows: DataFrame, keys: list[str], date: str, until: Column) -> DataFrame:
    """One row per key and day from the key's first date to `until`."""
    first = rows.groupBy(*keys).agg(F.min(date).alias("__first"))
    return first.select(*keys, F.explode(F.sequence("__first", until)).alias(date))


def carry(rows: DataFrame, keys: list[str], date: str, until: Column, values: list[str], since: Column | None = None) -> DataFrame:
    """D10 on D11: every day from each row's date to the day before the next one of its keys, the last to `until`.

    One window over the rows themselves, before they are spread over days; days are made in place, without a
    join. Of rows with equal keys and date one counts; rows after `until` or without a date are left out. With
    `since` only the days from there on are made, from what each key's last row before them says.
    """
    r = rows.where(F.col(date) <= until)
    last = F.coalesce(F.date_sub(F.lead(date).over(Window.partitionBy(*keys).orderBy(date)), 1), until)
    r = r.withColumn("__last", last).where(F.col("__last") >= F.col(date))
    first = F.col(date)
    if since is not None:
        r, first = r.where(F.col("__last") >= since), F.greatest(first, since)
    return r.select(*keys, F.explode(F.sequence(first, F.col("__last"))).alias(date), *values)


def scd2_upsert(current: DataFrame, incoming: DataFrame, key: str = "ticker", attributes: tuple[str, ...] = ("sector", "industry")) -> DataFrame:
    """D3: all versions after an upload of (key, attributes, as_of).

    New keys open a version at as_of. Unchanged ones move their start back if as_of is earlier. Changed ones
    close the current version the day before the new one opens, so no day has two versions.
    """
    cur = current.where("is_current").alias("c")
    new = incoming.alias("n")
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(f"c.{a}").eqNullSafe(F.col(f"n.{a}"))
    version = lambda side, start, end, live: F.struct(F.coalesce(F.col(f"n.{key}"), F.col(f"c.{key}")).alias(key), *[F.col(f"{side}.{a}").alias(a) for a in attributes], start.alias("effective_from"), end.alias("effective_to"), F.lit(live).alias("is_current"))
    forever = F.lit(END_OF_TIME).cast("date")
    old_from, as_of = F.col("c.effective_from"), F.col("n.as_of")
    fresh = F.array(version("n", as_of, forever, True))
    kept = F.array(version("c", F.when(as_of < old_from, as_of).otherwise(old_from), forever, True))
    changed = F.array(version("c", old_from, F.date_sub(as_of, 1), False), version("n", as_of, forever, True))
    choice = F.when(F.col(f"c.{key}").isNull(), fresh).when(F.col(f"n.{key}").isNull() | same, kept).otherwise(changed)
    after = cur.join(new, F.col(f"c.{key}") == F.col(f"n.{key}"), "full").select(F.inline(choice))
    return current.where("not is_current").select(*after.columns).unionByName(after)


def resolve_at(rows: DataFrame, versions: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """Rows with the values of the version valid on their date; rows without one are dropped."""
    v = versions.select(F.col(key), *values, "effective_from", "effective_to")
    return rows.join(v, key).where(F.col(date).between(F.col("effective_from"), F.col("effective_to"))).drop("effective_from", "effective_to")


def unresolved_at(rows: DataFrame, versions: DataFrame, key: str, date: str) -> DataFrame:
    """Rows whose date no version covers."""
    v = versions.select(F.col(key).alias("__k"), "effective_from", "effective_to")
    return rows.join(v, (F.col(key) == F.col("__k")) & F.col(date).between(F.col("effective_from"), F.col("effective_to")), "left_anti")


def base_symbol(ticker: str) -> Column:
    """Upper-cased text before the first full stop."""
    return F.split_part(F.upper(F.trim(F.col(ticker))), F.lit("."), F.lit(1))


def pick_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def correct_listing(trades: DataFrame, prices: DataFrame, suffixes: tuple[str, str] = ("NS", "BO"), least: int = 10) -> DataFrame:
    """Ticker, renamed: tickers with under `least` price rows become their other listing if that has enough."""
    n = prices.groupBy("ticker").agg(F.count("*").alias("n"))
    t = trades.select("ticker").distinct()
    twin = F.concat(base_symbol("ticker"), F.lit("."), F.when(F.col("ticker").endswith("." + suffixes[0]), suffixes[1]).otherwise(suffixes[0]))
    both = t.withColumn("twin", twin).join(n, "ticker", "left").join(n.select(F.col("ticker").alias("twin"), F.col("n").alias("m")), "twin", "left")
    return both.select("ticker", F.when((F.coalesce("n", F.lit(0)) < least) & (F.coalesce("m", F.lit(0)) >= least), F.col("twin")).otherwise(F.col("ticker")).alias("renamed"))
