"""Ledger validation and cleaning: every rejected row keeps a reason; counts are one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.temporal import base_symbol, pick_one
from tallyfold.sources.shared import staged

# Fixed values.
COLUMNS = ["date", "ticker", "transaction_type", "quantity", "price", "fees", "tax", "currency"]
TYPES = ["BUY", "SELL", "DIVIDEND", "DEPOSIT", "WITHDRAWAL"]
RATES = {"INR": 1.0, "USD": 83.0, "EUR": 90.0}
SUFFIXES = {"NS": "NSE", "BO": "BSE"}
SUFFIX_CURRENCY = "INR"
ANOMALY = 0.15


def kind() -> Column:
    return F.upper(F.trim("transaction_type"))


def parsed_date() -> Column:
    """V2: ISO dates only; day/month/year with slashes is ambiguous and stays null."""
    return F.when(~F.trim("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.expr("try_cast(trim(date) as date)"))


def number(column: str) -> Column:
    """Null where it is no finite number."""
    x = F.expr(f"try_cast(trim({column}) as double)")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def reason(today: str, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> Column:
    """V1-V7: the first rule that a row fails, or null."""
    trade = kind().isin("BUY", "SELL")
    slash = F.trim("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    good = F.upper(F.trim("ticker")).rlike(rf"^[A-Z0-9&\-]+\.({'|'.join(suffixes)})$")
    positive = lambda c: F.coalesce(number(c) > 0, F.lit(False))
    return F.coalesce(
        F.when(~F.coalesce(kind().isin(TYPES), F.lit(False)), "unknown transaction type"),
        F.when(F.coalesce(slash, F.lit(False)), "ambiguous date"),
        F.when(parsed_date().isNull(), "invalid date"),
        F.when(parsed_date() > F.lit(today).cast("date"), "future date"),
        F.when(kind().isin("BUY", "SELL", "DIVIDEND") & ~F.coalesce(good, F.lit(False)), "malformed ticker"),
        F.when(trade & ~positive("quantity"), "invalid quantity"),
        F.when(trade & ~positive("price"), "invalid price"),
    )


def validate(raw: DataFrame, today: str) -> DataFrame:
    return raw.withColumn("reason", reason(today))


def split_adjust(ledger: DataFrame, splits: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """V9: quantities times, prices over, the product of later splits' ratios; the value stays.

    A split that both listings report counts once. A symbol's splits cut time into spans with one factor each;
    trades meet these few rows by symbol, so the ledger is read once and not dealt anew. `id_cols` is not needed
    any more.
    """
    note = F.format_string("%s x%s", F.date_format("split_date", "yyyy-MM-dd"), F.col("ratio").cast("string"))
    days = splits.select("symbol", "split_date", "ratio").distinct().groupBy("symbol", "split_date").agg(F.product("ratio").alias("ratio"), F.collect_list(note).alias("notes"))
    w = Window.partitionBy("symbol").orderBy("split_date")
    later = w.rowsBetween(0, Window.unboundedFollowing)
    spans = days.select(F.col("symbol").alias("__symbol"), F.lag("split_date").over(w).alias("__since"), F.col("split_date").alias("__until"), F.product("ratio").over(later).alias("__factor"), F.array_join(F.array_sort(F.flatten(F.collect_list("notes").over(later))), "; ").alias("__note"))
    within = (F.col("date") < F.col("__until")) & (F.col("__since").isNull() | (F.col("date") >= F.col("__since")))
    j = ledger.join(staged(spans, "splits"), (F.col("symbol") == F.col("__symbol")) & within & F.col("kind").isin("BUY", "SELL"), "left")
    j = j.select(*ledger.columns, F.coalesce("__factor", F.lit(1.0)).alias("factor"), F.col("__note").alias("note"))
    return j.withColumn("qty", F.col("qty") * F.col("factor")).withColumn("price", F.col("price") / F.col("factor"))


def clean(valid: DataFrame, aliases: DataFrame, rates: DataFrame, keys: list[str], row: str = "rid", threshold: float = ANOMALY) -> DataFrame:
    """C1-C9 of validated rows: typed columns, imputations, base currency, duplicates dropped, flags set.

    aliases: alias, ticker. rates: currency, rate. Both are reference tables; Catalyst picks their joins. Rows are
    dealt once, by the keys and ticker that duplicates and prices before share; what one row alone decides is
    worked out before and after, so that the rows dealt are short.
    """
    t = valid.withColumn("raw_ticker", F.upper(F.trim("ticker"))).join(aliases.select(F.col("alias").alias("raw_ticker"), F.col("ticker").alias("__to")), "raw_ticker", "left")
    typed = [F.coalesce("__to", "raw_ticker").alias("ticker"), parsed_date().alias("date"), kind().alias("transaction_type"), *[number(c).alias(c) for c in ("quantity", "price", "fees", "tax")]]
    t = t.select(*keys, row, *typed, F.col("currency").alias("currency_original"))
    t = t.repartition(*keys, "ticker")
    t = pick_one(t, [*keys, "ticker", "date", "transaction_type", "quantity", "price"], [F.col(row)])
    t = t.withColumn("near_duplicate", F.count("*").over(Window.partitionBy(*keys, "ticker", "date")) > 1)
    trade = F.col("transaction_type").isin("BUY", "SELL")
    before = F.last(F.when(trade, F.col("price")), ignorenulls=True).over(Window.partitionBy(*keys, "ticker").orderBy("date", row).rowsBetween(Window.unboundedPreceding, -1))
    moved = F.abs(F.col("price") - before) / F.when(before != 0, before) > threshold
    t = t.withColumn("anomaly", trade & F.coalesce(moved, F.lit(False)))
    blank = F.coalesce(F.trim("currency_original"), F.lit("")) == ""
    known = F.substring_index("ticker", ".", -1).isin(*SUFFIXES)
    t = t.withColumn("imputed", F.col("fees").isNull().cast("int") + F.col("tax").isNull().cast("int") + (blank & F.coalesce(known, F.lit(False))).cast("int"))
    t = t.withColumn("fees", F.coalesce("fees", F.lit(0.0))).withColumn("tax", F.coalesce("tax", F.lit(0.0)))
    t = t.withColumn("currency", F.when(~blank, F.upper(F.trim("currency_original"))).when(known, SUFFIX_CURRENCY))
    t = t.join(rates.dropDuplicates(["currency"]), "currency", "left").withColumn("price_base", F.col("price") * F.col("rate")).withColumn("unresolved", F.col("rate").isNull())
    return t.select(*keys, row, "date", "ticker", "transaction_type", "quantity", "price", "fees", "tax", "currency", "currency_original", "price_base", "imputed", "unresolved", "near_duplicate", "anomaly")


def quality_report(validated: DataFrame, cleaned: DataFrame, keys: list[str], adjusted: DataFrame | None = None) -> DataFrame:
    """Counters per upload, and the split adjustments made: how many rows, and a note for each split.

    adjusted: keys, symbol, note of the trades as V9 gives them; notes are as many as there were splits.
    """
    a = validated.groupBy(*keys).agg(F.count("*").alias("rows_in"), F.count("reason").alias("rows_rejected"))
    b = cleaned.groupBy(*keys).agg(F.count("*").alias("rows_cleaned"), F.count_if("near_duplicate").alias("near_duplicates_flagged"), F.sum("imputed").alias("values_imputed"), F.count_if("anomaly").alias("anomalies_flagged"), F.count_if("unresolved").alias("rows_unresolved"))
    out = a.join(b, keys, "left").withColumn("duplicates_dropped", F.col("rows_in") - F.col("rows_rejected") - F.coalesce("rows_cleaned", F.lit(0)))
    if adjusted is None:
        return out.withColumn("split_adjustments_applied", F.lit(0).cast("long")).withColumn("notes", F.array().cast("array<string>"))
    each = adjusted.where("note is not null").groupBy(*keys, "symbol", "note").agg(F.count("*").alias("n"))
    note = lambda x: F.format_string("%s: %s (%d rows)", x["symbol"], x["note"], x["n"])
    g = each.groupBy(*keys).agg(F.sum("n").alias("split_adjustments_applied"), F.transform(F.sort_array(F.collect_list(F.struct("symbol", "note", "n"))), note).alias("notes"))
    return out.join(g, keys, "left").withColumn("split_adjustments_applied", F.coalesce("split_adjustments_applied", F.lit(0).cast("long"))).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def metadata(tickers: DataFrame, known: DataFrame) -> DataFrame:
    """Name, sector, industry, exchange and currency of tickers; sector and industry may be missing."""
    base = base_symbol("ticker")
    suffix = F.substring_index("ticker", ".", -1)
    exchange = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return tickers.withColumn("asset_name", base).join(known, "asset_name", "left").select("ticker", "asset_name", "sector", "industry", F.get(F.array(F.element_at(exchange, suffix)), 0).alias("exchange"), F.when(suffix.isin(*SUFFIXES), SUFFIX_CURRENCY).alias("currency"))
