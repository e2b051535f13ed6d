"""Queries over the given tables, one per operator, with independently formulated SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import stats as st
from tallyfold.operators import allocation as al
from tallyfold.operators import expectations as ex
from tallyfold.operators import forecast as fc
from tallyfold.operators import holdings as ho
from tallyfold.operators import performance as pf
from tallyfold.operators import regime as rg
from tallyfold.operators import risk as rk
from tallyfold.operators import temporal as tp
from tallyfold.operators import validation as va
from tallyfold.operators.scan import prefix
from tallyfold.plans import adapter as ad
from tallyfold.plans.adapter import AS_OF, CUBE, INDEX, MONTHLY, PRICES, RAW, RAW_FINE, TO_HELD, TO_LEDGER, TO_MARKED, TO_NAV, sql, table
from tallyfold.sources import marts, stores
from tallyfold.sources.shared import shared_dir, staged
from tallyfold.streaming.advance import outcomes, run, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, as the SQL rounds them; sums of money often end in a 5, which a nudge moves off the edge."""
    return df.select(*[F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Book:
    """The trade model's tables, each built when asked for; the accepted ledger is written once and read again."""

    def __init__(self, spark: SparkSession, d: str, fine: bool = False):
        self.spark, self.d = spark, d
        self.trades = ad.raw_trades(spark, d, fine)
        self.prices = ad.prices(spark, d)

    @cached_property
    def ledger(self):
        return staged(ho.accepted(self.trades), "ledger")

    @cached_property
    def as_of(self):
        last = self.ledger.agg(F.max("date")).first()[0]
        return F.lit(str(last)).cast("date")

    @property
    def held(self):
        return ho.positions(ho.moves(self.ledger))

    @property
    def cube(self):
        return ho.daily_cube(self.held, self.as_of)

    @property
    def marked(self):
        return ho.mark_to_market(self.cube, self.prices, self.as_of)

    @property
    def nav(self):
        return ho.nav(self.marked, ho.running_cash(ho.cash_delta(self.ledger)), self.as_of)

    def marked_between(self, start: str, end: str):
        """The marked cube's days from start to end, from the states and closes on the first of them on."""
        a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
        return ho.mark_to_market(ho.daily_cube(self.held, b, since=a), self.prices, b, a)

    def nav_between(self, start: str, end: str):
        a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
        return ho.nav(self.marked_between(start, end), ho.running_cash(ho.cash_delta(self.ledger)), b, a)

    def stored(self, rows, name, key="portfolio", date="date"):
        """Rows written as a mart; returns a reader of it."""
        path = f"{shared_dir(self.spark)}/tallyfold/mart-{name}-{uuid4().hex}"
        marts.write(rows, path, key, date)
        schema = marts.placed(rows, key, date).schema
        return lambda value=None, start=None, end=None: marts.read(self.spark, path, key, date, schema, value, start, end)

    @property
    def last_day(self):
        """The cube's last day, without the days before it: each position's last state and each symbol's last close."""
        last = self.held.groupBy(*ho.KEY).agg(F.max_by(F.struct("qty", "cost"), "date").alias("x")).select(*ho.KEY, self.as_of.alias("date"), "x.qty", "x.cost")
        closes = self.prices.where(F.col("date") <= self.as_of).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
        return last.join(closes, "symbol", "left").withColumn("mv", F.col("qty") * F.coalesce("close", F.lit(0.0)))

    @property
    def last_nav(self):
        """The last day's net asset value and its parts."""
        day = self.last_day.groupBy("portfolio").agg(F.sum("mv").alias("mv"), F.sum("cost").alias("cost"))
        cash = ho.cash_delta(self.ledger).groupBy("portfolio").agg(F.sum("delta").alias("balance"))
        return day.join(cash, "portfolio", "left").select("portfolio", "mv", "cost", F.coalesce("balance", F.lit(0.0)).alias("cash"))

    @property
    def monthly(self):
        return self.prices.groupBy("symbol", F.last_day("date").alias("date")).agg(F.max_by("close", "date").alias("close"))

    @property
    def index(self):
        li = table(self.spark, self.d, "lineitem")
        return li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))

    @property
    def sectors(self):
        p = table(self.spark, self.d, "part")
        currency = F.when(F.min("p_size") % 2 == 0, "USD").when(F.max("p_size") % 2 == 0, "EUR").otherwise("INR")
        return p.groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("sector"), F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("industry"), currency.alias("currency"))


SECTORS = "sectors as (select p_brand as symbol, min(p_type) as sector, min(split_part(p_name, ' ', 1)) as industry, case when min(p_size) % 2 = 0 then 'USD' when max(p_size) % 2 = 0 then 'EUR' else 'INR' end as currency from part group by 1)"
LAST = "last_day as (select * from marked where date = (select day from as_of))"

# ---- sources, sinks, dimensions


@query(sql(PRICES, "select symbol, date, round(close, 9) as close, volume from prices"))
def s2_price_window(spark, d):
    want = table(spark, d, "part").select(F.col("p_brand").alias("symbol"))
    rows, _ = stores.read_prices(ad.prices(spark, d), want, "1990-01-01", "2010-01-01")
    return r(rows.select("symbol", "date", "close", "volume"), 9)


@query("select p_brand || '?' as symbol from part group by 1")
def s2_missing_tickers(spark, d):
    want = table(spark, d, "part").select("p_brand").distinct()
    want = want.select(F.col("p_brand").alias("symbol")).union(want.select(F.concat("p_brand", F.lit("?"))))
    return stores.read_prices(ad.prices(spark, d), want, "1990-01-01", "2010-01-01")[1]


SPLITS = "splits as (select distinct p_brand as symbol, date '1998-06-17' as split_date, cast(case cast(right(p_brand, 1) as integer) % 3 when 0 then 2 when 1 then 5 else 10 end as double) as ratio from part)"


def splits(spark, d):
    digit = F.right("p_brand", F.lit(1)).cast("int") % 3
    return table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.lit("1998-06-17").cast("date").alias("split_date"), F.when(digit == 0, 2.0).when(digit == 1, 5.0).otherwise(10.0).alias("ratio")).distinct()


@query(sql(SPLITS, "select symbol, split_date, ratio from splits where split_date between date '1998-01-01' and date '1998-12-31'"))
def s3_split_events(spark, d):
    return stores.read_splits(splits(spark, d), "1998-01-01", "1998-12-31")


TICKERS = """select distinct upper(replace(p_brand, '#', '')) || case when l_suppkey % 2 = 0 then '.NS' else '.BO' end as ticker from lineitem join part on l_partkey = p_partkey"""


def tickers(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    t = F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(F.col("l_suppkey") % 2 == 0, ".NS").otherwise(".BO"))
    return li.join(p, li.l_partkey == p.p_partkey).select(t.alias("ticker")).distinct()


@query(f"""with t as ({TICKERS}), k as (select upper(replace(p_brand, '#', '')) as asset_name, min(p_type) as sector, min(split_part(p_name, ' ', 1)) as industry from part where p_brand <> 'Brand#11' group by 1)
select t.ticker, split_part(t.ticker, '.', 1) as asset_name, k.sector, k.industry, case when t.ticker like '%.NS' then 'NSE' else 'BSE' end as exchange, 'INR' as currency from t left join k on k.asset_name = split_part(t.ticker, '.', 1)""")
def s4_asset_metadata(spark, d):
    p = table(spark, d, "part").where("p_brand <> 'Brand#11'")
    known = p.groupBy(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("asset_name")).agg(F.min("p_type").alias("sector"), F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("industry"))
    return va.metadata(tickers(spark, d), known)


@query(sql(PRICES, "select symbol, date, round(close, 9) as close, volume from prices"))
def s5_price_cache(spark, d):
    path = f"{shared_dir(spark)}/tallyfold/prices-{uuid4().hex}"
    stores.write_prices(ad.prices(spark, d), path)
    return r(stores.read_price_cache(spark, path).select("symbol", "date", "close", "volume"), 9)


@query(sql(RAW, "select portfolio, case when portfolio in ('BUILDING', 'MACHINERY') then count(*) filter (kind = 'BUY') else count(*) end as n, round(case when portfolio in ('BUILDING', 'MACHINERY') then sum(qty) filter (kind = 'BUY') else sum(qty) end, 2) as qty from raw group by 1"))
def s7_replace_history(spark, d):
    """Two portfolios' histories are replaced by their buys; an upload without rows then changes nothing."""
    path = f"{shared_dir(spark)}/tallyfold/history-{uuid4().hex}"
    t = ad.raw_trades(spark, d).select("portfolio", "symbol", "date", "kind", "qty", "row_idx")
    stores.replace_history(t, path)
    stores.replace_history(t.where("portfolio in ('BUILDING', 'MACHINERY') and kind = 'BUY'"), path)
    stores.replace_history(t.where("false"), path)
    return r(spark.read.parquet(path).groupBy("portfolio").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")), 2)


@query(sql(PRICES, """nw as (select symbol, date, close + 1 as close, volume + 1 as volume from prices where date >= '2001-01-01')
select symbol, date, round(coalesce(n.close, p.close), 9) as close, coalesce(n.volume, p.volume) as volume from prices p full join nw n using (symbol, date)"""))
def s8_price_upsert(spark, d):
    """The stored prices, after a batch of newer ones was merged into them twice."""
    p = ad.prices(spark, d).select("symbol", "date", "close", "volume", F.lit(1).alias("v"))
    path = f"{shared_dir(spark)}/tallyfold/prices-{uuid4().hex}"
    marts.write(p, path, "symbol", "date")
    new = p.where("date >= '2001-01-01'").select("symbol", "date", (F.col("close") + 1).alias("close"), (F.col("volume") + 1).alias("volume"), F.lit(2).alias("v"))
    for _ in range(2):
        marts.merge(new, path, "symbol", "date", ["symbol", "date"], "v")
    return r(marts.read(spark, path, "symbol", "date", marts.placed(p, "symbol", "date").schema).drop("v"), 9)


@query(sql(RAW, "select portfolio, symbol, date, kind, qty, round(price, 9) as price, max(row_idx) as lineage from raw group by all"))
def s9_ledger_upsert(spark, d):
    """A ledger stored from the trades of even rows, into which all trades are merged."""
    key = ["portfolio", "symbol", "date", "kind", "qty", "price"]
    t = staged(ad.raw_trades(spark, d).withColumn("price", F.round("price", 9)).select(*key, F.col("row_idx").alias("lineage")), "trades")
    path = f"{shared_dir(spark)}/tallyfold/ledger-{uuid4().hex}"
    marts.write(tp.pick_one(t.where("lineage % 2 = 0"), key, [F.desc("lineage")]), path, "portfolio", "date")
    marts.merge(t, path, "portfolio", "date", key, "lineage")
    return marts.read(spark, path, "portfolio", "date", marts.placed(t, "portfolio", "date").schema)


@query(sql(*TO_NAV, """gone as (select portfolio from (values ('BUILDING'), ('MACHINERY'), ('NOBODY')) t(portfolio)),
select 'portfolio' as table_name, c_mktsegment as portfolio, 1 as n from customer where c_mktsegment not in (from gone) group by 2 union all
select 'ledger', portfolio, count(*) from ledger where portfolio not in (from gone) group by 2 union all
select 'holdings', portfolio, count(*) from held where portfolio not in (from gone) group by 2 union all
select 'value', portfolio, count(*) from nav where portfolio not in (from gone) group by 2 union all
select 'returns', portfolio, count(*) from rets where portfolio not in (from gone) and r is not null group by 2 union all
select 'absent', portfolio, 1 from gone where portfolio not in (select c_mktsegment from customer)"""))
def s10_cascade_delete(spark, d):
    b = Book(spark, d)
    gone = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOBODY",)], "portfolio string")
    names, values = table(spark, d, "customer").select(F.col("c_mktsegment").alias("portfolio")).distinct(), staged(b.nav, "nav")
    tables = {"portfolio": names, "ledger": b.ledger, "holdings": b.held, "value": values, "returns": ho.nav_returns(values).where("r is not null")}
    out = stores.absent(gone, names).select(F.lit("absent").alias("table_name"), "portfolio", F.lit(1).cast("long").alias("n"))
    for name, rows in stores.delete_cascade(tables, gone).items():
        one = rows.groupBy("portfolio").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "portfolio", "n")
        out = out.union(one)
    return out


@query("""with e as (select 7 as top), n as (select distinct c_mktsegment as portfolio from customer where c_mktsegment <> 'BUILDING')
select 7 + row_number() over (order by portfolio) as portfolio_id, portfolio from n""")
def s11_register(spark, d):
    old = spark.createDataFrame([(7, "BUILDING")], "portfolio_id long, portfolio string")
    return stores.register(old, table(spark, d, "customer").select(F.col("c_mktsegment").alias("portfolio")))


RUNS = """runs as (select user_id as run_id, min(ts) as started_at, max(case when event_type in ('purchase', 'error') then ts end) as completed_at,
  max(cast(value as bigint)) as rows_processed from events group by 1)"""


def run_log(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("at")).withColumn("status", F.lit("RUNNING"))
    ends = e.where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"), F.concat(F.repeat(F.lit("x"), F.lit(9000)), F.lit("end")).alias("error"))
    rows = e.select(F.col("user_id").alias("run_id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("value").cast("long").alias("rows_processed"))
    return first.unionByName(ends, allowMissingColumns=True).withColumn("rows_processed", F.lit(None).cast("long")).unionByName(rows, allowMissingColumns=True)


@query(sql(RUNS, "select run_id, started_at, completed_at, date_diff('second', date_trunc('second', started_at), date_trunc('second', completed_at)) as duration_seconds, case when completed_at is null then null else 8000 end as error_chars from runs"))
def s12_run_log(spark, d):
    return stores.fold_runs(run_log(spark, d)).select("run_id", "started_at", "completed_at", "duration_seconds", F.length("error").alias("error_chars"))


@query(sql(RUNS, "select run_id, started_at from runs order by started_at desc, run_id desc limit 20"))
def s13_latest_runs(spark, d):
    return stores.latest_runs(stores.fold_runs(run_log(spark, d))).select("run_id", "started_at")


CAL = """cal as (select cast(unnest(generate_series((select min(cast(l_shipdate as date)) from lineitem), (select max(cast(l_shipdate as date)) from lineitem), interval 1 day)) as date) as full_date)"""


def _calendar(spark, d):
    """The calendar of the trades' days, from the first to the last."""
    day = F.col("l_shipdate").cast("date")
    a, b = table(spark, d, "lineitem").agg(F.min(day), F.max(day)).first()
    return (str(a), str(b)) if a else ("1995-01-01", "1995-01-01")


@query(sql(CAL, "select l_orderkey as transaction_id, full_date as txn_date, cast(l_quantity as decimal(18,6)) as quantity, strftime(full_date, '%Y%m%d') as date_key from lineitem left join cal on full_date = cast(l_shipdate as date) and isodow(full_date) < 6"))
def s14_staging(spark, d):
    """Facts keep their rows where the calendar (here its trading days) lacks theirs; their date is then null."""
    days = tp.calendar(spark, *_calendar(spark, d)).where("is_trading_day").select("date_key", "full_date")
    facts = table(spark, d, "lineitem").withColumn("key", F.date_format("l_shipdate", "yyyyMMdd").cast("int"))
    return facts.join(days, F.col("key") == F.col("date_key"), "left").select(F.col("l_orderkey").alias("transaction_id"), F.col("full_date").alias("txn_date"), F.col("l_quantity").cast("decimal(18,6)").alias("quantity"), F.col("date_key").cast("string").alias("date_key"))


@query("select o_orderkey as transaction_id, o_totalprice as dividend_amount from orders where o_orderstatus = 'F'")
def s15_dividends(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("dividend_amount"))


@query(sql(CAL, """select cast(strftime(full_date, '%Y%m%d') as integer) as date_key, full_date, day(full_date) as day_of_month, isodow(full_date) as day_of_week, dayname(full_date) as day_name, week(full_date) as week_of_year,
  month(full_date) as month_num, monthname(full_date) as month_name, quarter(full_date) as quarter, year(full_date) as year, isodow(full_date) < 6 as is_trading_day from cal"""))
def d1_calendar(spark, d):
    return tp.calendar(spark, *_calendar(spark, d))


@query(sql(CAL, "select full_date from cal where full_date not in (select cast(o_orderdate as date) from orders)"))
def d2_calendar_extension(spark, d):
    have = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("full_date")).distinct()
    return tp.extend_calendar(have, *_calendar(spark, d)).select("full_date")


CURRENT = "cur as (select p_brand as ticker, min(p_type) as sector, cast(null as varchar) as industry, date '1996-01-01' as effective_from from part where right(p_brand, 1) <> '3' group by 1), inc as (select p_brand as ticker, case when right(p_brand, 1) = '2' then max(p_type) || '*' else min(p_type) end as sector, cast(null as varchar) as industry, case when right(p_brand, 1) = '1' then date '1995-01-01' else date '1998-01-01' end as as_of from part where right(p_brand, 1) <> '4' group by 1)"


def _versions(spark, d):
    p = table(spark, d, "part").withColumn("k", F.right("p_brand", F.lit(1)))
    none = F.lit(None).cast("string").alias("industry")
    cur = p.where("k <> '3'").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("sector")).select("ticker", "sector", none, F.lit("1996-01-01").cast("date").alias("effective_from"), F.lit(tp.END_OF_TIME).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))
    inc = p.where("k <> '4'").groupBy(F.col("p_brand").alias("ticker"), "k").agg(F.when(F.col("k") == "2", F.concat(F.max("p_type"), F.lit("*"))).otherwise(F.min("p_type")).alias("sector")).select("ticker", "sector", none, F.when(F.col("k") == "1", F.lit("1995-01-01")).otherwise(F.lit("1998-01-01")).cast("date").alias("as_of"))
    return tp.scd2_upsert(cur, inc)


VERSIONS = CURRENT + """,
versions as (
  select ticker, i.sector, i.as_of as effective_from, date '9999-12-31' as effective_to, true as is_current from inc i where ticker not in (select ticker from cur)
  union all select ticker, c.sector, case when i.as_of < c.effective_from then i.as_of else c.effective_from end, date '9999-12-31', true from cur c left join inc i using (ticker) where i.ticker is null or i.sector is not distinct from c.sector
  union all select ticker, c.sector, c.effective_from, i.as_of - 1, false from cur c join inc i using (ticker) where i.sector is distinct from c.sector
  union all select ticker, i.sector, i.as_of, date '9999-12-31', true from cur c join inc i using (ticker) where i.sector is distinct from c.sector)"""


@query(sql(VERSIONS, "select ticker, sector, effective_from, effective_to, is_current from versions"))
def d3_scd2_upsert(spark, d):
    return _versions(spark, d).drop("industry")


@query(sql(VERSIONS, RAW, "select symbol, sector, count(*) as n from raw join versions on symbol = ticker and date between effective_from and effective_to group by 1, 2"))
def d4_point_in_time(spark, d):
    t = ad.raw_trades(spark, d).withColumn("ticker", F.col("symbol"))
    return tp.resolve_at(t, _versions(spark, d), "ticker", "date", ["sector"]).groupBy("symbol", "sector").agg(F.count("*").alias("n"))


@query(sql(VERSIONS, RAW, "select symbol, date, count(*) as n from raw where not exists (select 1 from versions where symbol = ticker and date between effective_from and effective_to) group by 1, 2"))
def d4_unresolved(spark, d):
    t = ad.raw_trades(spark, d).withColumn("ticker", F.col("symbol"))
    return tp.unresolved_at(t, _versions(spark, d), "ticker", "date").groupBy("symbol", "date").agg(F.count("*").alias("n"))


@query(sql(*TO_HELD, VERSIONS, "select portfolio, symbol, date, sector, round(cost, 4) as cost from held join versions on symbol = ticker and date between effective_from and effective_to"))
def d5_attributes_as_of(spark, d):
    h = Book(spark, d).held.withColumn("ticker", F.col("symbol"))
    return r(tp.resolve_at(h, _versions(spark, d), "ticker", "date", ["sector"]).select("portfolio", "symbol", "date", "sector", "cost"), 4)


@query(sql(*TO_LEDGER, INDEX, """firsts as (select portfolio, min(date) as day from ledger group by 1)
select 'INDEX ' || portfolio as ticker, 'INDEX' as sector, least((select min(date) from idx where date >= date '1996-06-01'), day) as effective_from, date '9999-12-31' as effective_to, true as is_current from firsts"""))
def d6_benchmark_asset(spark, d):
    """The index's row of each portfolio, registered as of the index's first day from June 1996, is backdated to the portfolio's first trade."""
    b = Book(spark, d)
    cols = [F.concat(F.lit("INDEX "), "portfolio").alias("ticker"), F.lit("INDEX").alias("sector"), F.lit(None).cast("string").alias("industry")]
    firsts = staged(b.ledger.groupBy("portfolio").agg(F.min("date").alias("as_of")), "firsts")
    day = b.index.where("date >= '1996-06-01'").agg(F.min("date").alias("effective_from"))
    cur = firsts.crossJoin(F.broadcast(day)).select(*cols, "effective_from", F.lit(tp.END_OF_TIME).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))
    return tp.scd2_upsert(cur, firsts.select(*cols, "as_of")).drop("industry")


@query(f"""with t as ({TICKERS}) select split_part(ticker, '.', 1) as base, max(ticker) as ticker from t group by 1""")
def d7_canonical_asset(spark, d):
    return tp.pick_one(tickers(spark, d).withColumn("base", tp.base_symbol("ticker")), ["base"], [F.desc("ticker")])


@query(sql(PRICES, "select symbol, date, round(max(close), 9) as close from prices group by 1, 2"))
def d8_price_dedupe(spark, d):
    p = ad.prices(spark, d).select("symbol", "date", "close")
    twice = p.withColumn("current", F.lit(True)).unionByName(p.withColumn("close", F.col("close") - 1).withColumn("current", F.lit(False)))
    return r(tp.pick_one(twice, ["symbol", "date"], [F.desc("current")]).drop("current"), 9)


@query(f"""with t as ({TICKERS}), n as (select ticker, case when right(split_part(ticker, '.', 1), 1) = '1' and ticker like '%.NS' then 3 else 20 end as n from t)
select t.ticker, case when a.n < 10 and b.n >= 10 then b.ticker else t.ticker end as renamed from t join n a on a.ticker = t.ticker
left join n b on b.ticker = split_part(t.ticker, '.', 1) || case when t.ticker like '%.NS' then '.BO' else '.NS' end""")
def d9_listing_correction(spark, d):
    t = tickers(spark, d)
    thin = (F.right(tp.base_symbol("ticker"), F.lit(1)) == "1") & F.col("ticker").endswith(".NS")
    rows = t.select("ticker", F.explode(F.sequence(F.lit(1), F.when(thin, 3).otherwise(20))).alias("i"))
    return tp.correct_listing(t, rows)


@query(sql(RAW, PRICES, "select portfolio, symbol, row_idx, date, round(p.close, 9) as close from (select r.*, date - 1 as before from raw r) r asof left join (select symbol as s, date as pd, close from prices) p on r.symbol = p.s and r.before >= p.pd"))
def d10_asof_join(spark, d):
    t = ad.raw_trades(spark, d).select("portfolio", "symbol", "row_idx", "date", F.date_sub("date", 1).alias("before"))
    return r(tp.asof_join(t, ad.prices(spark, d), ["symbol"], "before", "date", ["close"], blocked=True).drop("before"), 9)


@query(sql(*TO_HELD, AS_OF, CUBE.split(",\ncube as")[0], "select portfolio, symbol, date from cube_days"))
def d11_densified_calendar(spark, d):
    b = Book(spark, d)
    return tp.densify(b.held, ho.KEY, "date", b.as_of)


# ---- validation and cleaning of text ledgers

TEXT = """text_rows as materialized (
  select c_mktsegment as portfolio, row_number() over (partition by c_mktsegment order by """ + ", ".join(ad.ORDER) + """, l_shipdate) as rid,
    case when l_orderkey % 41 = 0 then strftime(l_shipdate, '%d/%m/%Y') when l_orderkey % 43 = 0 then '2099-01-01' when l_orderkey % 59 = 0 then 'soon' else strftime(l_shipdate, '%Y-%m-%d') end as date,
    upper(replace(p_brand, '#', '')) || case when l_orderkey % 37 = 0 then '' when l_suppkey % 2 = 0 then '.NS' else '.BO' end as ticker,
    case when l_orderkey % 31 = 0 then 'PURCHASE' when l_orderkey % 29 = 0 then ' buy ' when l_returnflag = 'R' then 'SELL' else 'BUY' end as transaction_type,
    case when l_orderkey % 23 = 0 then '-5' when l_orderkey % 47 = 0 then 'abc' else cast(cast(l_quantity as integer) as varchar) end as quantity,
    case when l_orderkey % 53 = 0 then 'NaN' else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as price,
    case when l_orderkey % 19 = 0 then '' else '1.5' end as fees, case when l_orderkey % 17 = 0 then 'x' else '2.0' end as tax,
    case when l_orderkey % 13 = 0 then ' ' when l_orderkey % 11 = 0 then 'USD' when l_orderkey % 7 = 0 then 'XYZ' else 'INR' end as currency
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""

REASONS = TEXT + """,
reasons as (
  select *, case
    when upper(trim(transaction_type)) not in ('BUY', 'SELL', 'DIVIDEND', 'DEPOSIT', 'WITHDRAWAL') then 'unknown transaction type'
    when regexp_full_match(date, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') then 'ambiguous date'
    when try_cast(date as date) is null then 'invalid date'
    when try_cast(date as date) > date '2002-01-01' then 'future date'
    when not regexp_full_match(ticker, '[A-Z0-9&-]+[.](NS|BO)') then 'malformed ticker'
    when coalesce(try_cast(quantity as double), -1) <= 0 then 'invalid quantity'
    when price = 'NaN' or coalesce(try_cast(price as double), -1) <= 0 then 'invalid price' end as reason from text_rows)"""

CLEANED = REASONS + """,
typed as (
  select portfolio, rid, cast(date as date) as date, case when ticker = 'BRAND11.NS' then 'BRAND12.NS' else ticker end as ticker, upper(trim(transaction_type)) as transaction_type,
    cast(quantity as double) as quantity, cast(price as double) as price, coalesce(try_cast(fees as double), 0) as fees, coalesce(try_cast(tax as double), 0) as tax,
    case when trim(currency) = '' then 'INR' else currency end as currency, currency as currency_original, (try_cast(fees as double) is null)::int + (try_cast(tax as double) is null)::int + (trim(currency) = '')::int as imputed
  from reasons where reason is null),
deduped as (select * from typed qualify row_number() over (partition by portfolio, date, ticker, transaction_type, quantity, price order by rid) = 1),
cleaned as (
  select *, price * case currency when 'INR' then 1 when 'USD' then 83 when 'EUR' then 90 end as price_base, currency = 'XYZ' as unresolved,
    count(*) over (partition by portfolio, date, ticker) > 1 as near_duplicate,
    coalesce(abs(price - lag(price) over (partition by portfolio, ticker order by date, rid)) / lag(price) over (partition by portfolio, ticker order by date, rid) > 0.15, false) as anomaly
  from deduped)"""


def text_rows(spark, d):
    """The text ledger; its numbers count a portfolio's lines by order.

    Lines are counted by order, and the counts of a portfolio's orders run over ranges of them, so that numbers
    need no row but those of the line's own order: lines are dealt by order and by part, once each.
    """
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    owner = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment").join(n, "o_orderkey")
    owner = prefix(owner, ["c_mktsegment"], [F.col("o_orderkey")], {"upto": "n"}, name="orders").select("o_orderkey", "c_mktsegment", (F.col("upto") - F.col("n")).alias("before"))
    w = Window.partitionBy("l_orderkey", "c_mktsegment")
    rid = F.min("before").over(w) + F.row_number().over(w.orderBy(*ad.ORDER[1:], "l_shipdate"))
    j = li.join(owner, li.l_orderkey == owner.o_orderkey).withColumn("rid", rid).join(p, F.col("l_partkey") == F.col("p_partkey"))
    k = lambda n: F.col("l_orderkey") % n == 0
    return j.select(
        F.col("c_mktsegment").alias("portfolio"),
        "rid",
        F.when(k(41), F.date_format("l_shipdate", "dd/MM/yyyy")).when(k(43), "2099-01-01").when(k(59), "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(k(37), "").when(F.col("l_suppkey") % 2 == 0, ".NS").otherwise(".BO")).alias("ticker"),
        F.when(k(31), "PURCHASE").when(k(29), " buy ").when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("transaction_type"),
        F.when(k(23), "-5").when(k(47), "abc").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.when(k(53), "NaN").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price"),
        F.when(k(19), "").otherwise("1.5").alias("fees"),
        F.when(k(17), "x").otherwise("2.0").alias("tax"),
        F.when(k(13), " ").when(k(11), "USD").when(k(7), "XYZ").otherwise("INR").alias("currency"),
    )


def _cleaned(spark, d, twice=False):
    """Validated and cleaned rows; the former are written if they are read `twice`, so that lines are dealt once."""
    v = va.validate(text_rows(spark, d), "2002-01-01")
    v = staged(v, "validated") if twice else v
    aliases = spark.createDataFrame([("BRAND11.NS", "BRAND12.NS")], "alias string, ticker string")
    rates = spark.createDataFrame(list(va.RATES.items()), "currency string, rate double")
    return v, va.clean(v.where("reason is null"), aliases, rates, ["portfolio"])


@query(sql(TEXT, "select 'all' as portfolio, date, ticker, transaction_type, quantity, price, fees, tax, currency, count(*) as n from text_rows group by all"))
def s1_ledger_csv(spark, d):
    """The text ledger goes to CSV files and is read back as an upload."""
    path = f"{shared_dir(spark)}/tallyfold/upload-{uuid4().hex}"
    text_rows(spark, d).select(*va.COLUMNS).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return stores.read_ledger_csv(spark, path, "all").groupBy("portfolio", *va.COLUMNS).agg(F.count("*").alias("n"))


@query(sql(REASONS, "select portfolio, rid, reason from reasons"))
def v1_v7_reasons(spark, d):
    return va.validate(text_rows(spark, d), "2002-01-01").select("portfolio", "rid", "reason")


@query(sql(RAW, ad.WALK.split(",\nledger as")[0], "select portfolio, symbol, row_idx from walk where rejected"))
def v8_oversell(spark, d):
    return ho.mark_oversold(ad.raw_trades(spark, d)).where("rejected").select("portfolio", "symbol", "row_idx")


@query(sql(RAW, SPLITS, "select portfolio, raw.symbol, row_idx, round(qty * coalesce(ratio, 1), 10) as qty, round(price / coalesce(ratio, 1), 10) as price, case when ratio is not null then strftime(split_date, '%Y-%m-%d') || ' x' || cast(ratio as varchar) end as note from raw left join splits s on s.symbol = raw.symbol and s.split_date > raw.date"))
def v9_split_adjustment(spark, d):
    ids = ["portfolio", "symbol", "row_idx"]
    return r(va.split_adjust(ad.raw_trades(spark, d), splits(spark, d).union(splits(spark, d)), ids).select(*ids, "qty", "price", "note"), 10)


@query(f"with t as ({TICKERS}) select ticker, split_part(ticker, '.', 1) as base from t")
def v10_base_symbol(spark, d):
    return tickers(spark, d).select("ticker", tp.base_symbol("ticker").alias("base"))


@query(sql(CLEANED, "select portfolio, rid, date, ticker, transaction_type, quantity, price, fees, tax, currency, currency_original, price_base, imputed, unresolved, near_duplicate, anomaly from cleaned"))
def c1_c9_clean(spark, d):
    return _cleaned(spark, d)[1]


@query(sql(CLEANED, RAW, SPLITS, """adj as (select portfolio, raw.symbol, strftime(split_date, '%Y-%m-%d') || ' x' || cast(ratio as varchar) as note, count(*) as n from raw join splits s on s.symbol = raw.symbol and s.split_date > raw.date group by 1, 2, 3),
sa as (select portfolio, cast(sum(n) as bigint) as n, string_agg(symbol || ': ' || note || ' (' || n || ' rows)', '; ' order by symbol, note) as notes from adj group by 1)
select v.portfolio, v.rows_in, v.rows_rejected, c.rows_cleaned, c.near_duplicates_flagged, c.values_imputed, c.anomalies_flagged, c.rows_unresolved, v.rows_in - v.rows_rejected - c.rows_cleaned as duplicates_dropped, coalesce(sa.n, 0) as split_adjustments_applied, coalesce(sa.notes, '') as notes
from (select portfolio, count(*) as rows_in, count(reason) as rows_rejected from reasons group by 1) v join (select portfolio, count(*) as rows_cleaned, count(*) filter (near_duplicate) as near_duplicates_flagged, sum(imputed) as values_imputed, count(*) filter (anomaly) as anomalies_flagged, count(*) filter (unresolved) as rows_unresolved from cleaned group by 1) c using (portfolio) left join sa using (portfolio)"""))
def c10_quality_report(spark, d):
    v, c = _cleaned(spark, d, twice=True)
    adjusted = va.split_adjust(ad.raw_trades(spark, d), splits(spark, d))
    return va.quality_report(v, c, ["portfolio"], adjusted).withColumn("notes", F.array_join("notes", "; "))


@query(sql(*TO_HELD, """select * from (values
  ('unique order', (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1))),
  ('unique line', (select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1))),
  ('date not null', (select count(*) from lineitem where l_shipdate is null)),
  ('order known', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))),
  ('supplier known', (select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 3 <> 0))),
  ('flag accepted', (select count(*) from lineitem where l_returnflag not in ('A', 'N'))),
  ('discount in range', (select count(*) from lineitem where l_discount < 0.02 or l_discount > 0.08)),
  ('zero cost when not held', (select count(*) from held where abs(qty) <= 1e-9 and abs(cost) > 1e-6)),
  ('held not negative', (select count(*) from held where qty < -1e-9))) as t(expectation, n_violations)"""))
def q1_q8_expectations(spark, d):
    li, o, s = (table(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    held = Book(spark, d).held
    return ex.suite(
        {"unique order": ex.unique(o, "o_orderkey"), "unique line": ex.unique(li, "l_orderkey", "l_linenumber"), "order known": ex.related(li, "l_orderkey", o, "o_orderkey"), "supplier known": ex.related(li, "l_suppkey", s.where("s_suppkey % 3 <> 0"), "s_suppkey")},
        ex.violated(li, {"date not null": ex.is_missing("l_shipdate"), "flag accepted": ex.is_other("l_returnflag", ["A", "N"]), "discount in range": ex.is_outside("l_discount", 0.02, 0.08)}),
        ex.violated(held, {"zero cost when not held": ex.costs_unheld(), "held not negative": ex.is_outside("qty", low=-1e-9)}),
    )


@query(sql(VERSIONS, "select ticker, count(*) as n from versions where is_current or ticker like '%2' group by 1 having count(*) > 1"))
def q8_one_current(spark, d):
    v = _versions(spark, d)
    return ex.one_current(v.withColumn("is_current", F.col("is_current") | F.col("ticker").endswith("2")), "ticker")


# ---- holdings, cash, value


@query(sql(*TO_HELD[:3], "select portfolio, symbol, date, buy_qty, round(buy_cost, 4) as buy_cost, sell_qty from moves"))
def h1_moves(spark, d):
    return r(ho.moves(Book(spark, d).ledger), 4)


@query(sql(*TO_HELD, "select portfolio, symbol, date, round(qty + 0.000037, 3) as qty, round(cost + 0.000037, 3) as cost from held"))
def h2_h3_weighted_cost(spark, d):
    return r(Book(spark, d).held, 3, 0.000037)


@query(sql(*TO_HELD, AS_OF, PRICES, CUBE, "select portfolio, symbol, date, round(qty + 0.000037, 3) as qty, round(cost + 0.000037, 3) as cost from cube"))
def h4_daily_cube(spark, d):
    return r(Book(spark, d).cube.select("portfolio", "symbol", "date", "qty", "cost"), 3, 0.000037)


@query(sql(*TO_LEDGER, """flow as (select portfolio, symbol, date, sum(case when kind = 'BUY' then qty else -qty end) as dq, sum(case when kind = 'BUY' then qty * price else -qty * price end) as dc from ledger group by all),
run as (select portfolio, symbol, date, sum(dq) over w as qty, sum(dc) over w as net_invested from flow window w as (partition by portfolio, symbol order by date)),
days as (select portfolio, symbol, cast(unnest(generate_series(min(date), (select max(date) from raw), interval 1 day)) as date) as date from run group by 1, 2)
select d.portfolio, d.symbol, d.date, round(r.qty, 2) as qty, round(r.net_invested, 2) as net_invested from days d asof join run r on d.portfolio = r.portfolio and d.symbol = r.symbol and d.date >= r.date"""))
def h5_net_invested(spark, d):
    b = Book(spark, d)
    return r(ho.net_invested_cube(b.ledger, b.as_of).select("portfolio", "symbol", "date", "qty", "net_invested"), 2)


@query(sql(*TO_LEDGER, "select portfolio, date, round(sum(case when kind = 'SELL' then price * qty - fees - tax else 0 end) + 0.0000037, 4) as delta from ledger group by 1, 2"))
def k1_cash_delta(spark, d):
    return r(ho.cash_delta(Book(spark, d).ledger), 4, 0.0000037)


@query(sql(*TO_LEDGER, "k as (select portfolio, date, sum(case when kind = 'SELL' then price * qty - fees - tax else 0 end) as delta from ledger group by 1, 2)", "select portfolio, date, round(sum(delta) over (partition by portfolio order by date), 2) as balance from k"))
def k2_running_cash(spark, d):
    return r(ho.running_cash(ho.cash_delta(Book(spark, d).ledger)), 2)


@query(sql(*TO_NAV, "select portfolio, date, round(mv, 2) as mv, round(cost, 2) as cost, round(cash, 2) as cash, round(nav, 2) as nav from nav"))
def n1_n2_n4_nav(spark, d):
    return r(Book(spark, d).nav, 2)


@query(sql(*TO_NAV, "select portfolio, date, round(r, 8) as r from rets"))
def n3_nav_returns(spark, d):
    return r(ho.nav_returns(Book(spark, d).nav).select("portfolio", "date", "r"), 8)


@query(sql(*TO_NAV, "select portfolio, date, round(case when lag(mv) over w > 0 then (mv - lag(mv) over w) / lag(mv) over w end, 8) as daily_return, round(case when first_value(mv) over w > 0 then (mv - first_value(mv) over w) / first_value(mv) over w end, 6) as cumulative_return from nav window w as (partition by portfolio order by date)"))
def n5_inception_returns(spark, d):
    return r(ho.inception_returns(Book(spark, d).nav, "mv").withColumn("cumulative_return", F.round("cumulative_return", 6)), 8)


@query(sql(*TO_HELD, PRICES, AS_OF, """late as (select p.* from prices p join (select symbol as s, min(date) as first from prices group by 1) f on p.symbol = f.s where p.date >= f.first + 60)""", CUBE.replace("left join prices p", "left join late p"), "select portfolio, symbol, date, round(case when qty > 0 and abs(mv) < 1e-9 then cost else mv end + 0.00037, 2) as value from marked"))
def n6_gap_fill_at_cost(spark, d):
    """With prices that a source gives only from 60 days after a symbol's first trade on."""
    b = Book(spark, d)
    first = b.prices.groupBy("symbol").agg(F.min("date").alias("first"))
    late = b.prices.join(first, "symbol").where(F.col("date") >= F.date_add("first", 60)).drop("first")
    return r(ho.fill_gaps(ho.mark_to_market(b.cube, late, b.as_of)).select("portfolio", "symbol", "date", "value"), 2, 0.00037)


# ---- marts


@query(sql(*TO_MARKED, VERSIONS, "select portfolio, symbol, sector, count(*) as n, min(date) as first, max(date) as last, round(last(mv order by date) + 0.00037, 2) as mv, round(last(mv - cost order by date) + 0.00037, 2) as gain from marked join versions on symbol = ticker and date between effective_from and effective_to group by 1, 2, 3"))
def m1_asset_performance(spark, d):
    """Every day of the cube with the asset version valid on it, summed up by version."""
    m = tp.resolve_at(Book(spark, d).marked.withColumn("ticker", F.col("symbol")), _versions(spark, d), "ticker", "date", ["sector"])
    g = m.groupBy("portfolio", "symbol", "sector").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("mv", "date").alias("mv"), F.max_by(F.col("mv") - F.col("cost"), F.col("date")).alias("gain"))
    return r(g, 2, 0.00037)


@query(sql(*TO_MARKED, LAST, VERSIONS, SECTORS, """v as (select ticker, sector, effective_from, effective_to, case when right(sector, 1) = '*' then 'USD' else 'INR' end as currency from versions)
select portfolio, symbol, v.sector, v.currency, round(mv / sum(mv) over (), 6) as weight from last_day join v on symbol = ticker and date between effective_from and effective_to where portfolio = 'BUILDING'"""))
def s6_allocation_reader(spark, d):
    """One portfolio's allocation with the currency valid on its day."""
    b = Book(spark, d)
    versions = _versions(spark, d).withColumn("currency", F.when(F.col("sector").endswith("*"), "USD").otherwise("INR"))
    mart = tp.resolve_at(b.last_day.withColumn("ticker", F.col("symbol")), versions, "ticker", "date", ["sector", "currency"])
    mine = b.stored(mart, "allocation")("BUILDING").orderBy("date", "symbol")
    return r(mine.select("portfolio", "symbol", "sector", "currency", st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight")))


@query(sql(*TO_LEDGER, "select portfolio, date, symbol as ticker, kind, qty, row_idx from ledger where portfolio = 'BUILDING'"))
def s6_transactions_reader(spark, d):
    b = Book(spark, d)
    mine = b.stored(b.ledger, "transactions")("BUILDING").orderBy("date", "symbol", "row_idx")
    return mine.select("portfolio", "date", F.col("symbol").alias("ticker"), "kind", "qty", "row_idx")


@query(sql(*TO_NAV, "select portfolio, date, round(mv, 2) as mv, round(cash, 2) as cash, round(nav, 2) as nav, round(r, 6) as r from rets where portfolio = 'MACHINERY'"))
def s6_performance_reader(spark, d):
    b = Book(spark, d)
    mine = b.stored(ho.nav_returns(b.nav), "performance")("MACHINERY").orderBy("date")
    return r(mine.select("portfolio", "date", F.round("mv", 2).alias("mv"), F.round("cash", 2).alias("cash"), F.round("nav", 2).alias("nav"), "r"))


@query(sql(*TO_MARKED, "select portfolio, symbol, date, round(qty, 2) as qty, round(close, 9) as close, round(mv, 7) as mv from marked where portfolio = 'MACHINERY' and date between date '1996-01-01' and date '1996-06-30'"))
def s6_asset_reader(spark, d):
    """Half a year of one portfolio's assets from the stored cube: six months' folders of one bucket."""
    b = Book(spark, d)
    mine = b.stored(b.marked, "assets")("MACHINERY", "1996-01-01", "1996-06-30").orderBy("date", "symbol")
    return mine.select("portfolio", "symbol", "date", F.round("qty", 2).alias("qty"), F.round("close", 9).alias("close"), F.round("mv", 7).alias("mv"))


@query(sql(*TO_NAV, INDEX, "select n.portfolio, n.date, round(n.r, 6) as r, round(i.close, 6) as close from rets n join idx i on n.date = i.date where n.portfolio = 'FURNITURE'"))
def s6_benchmark_reader(spark, d):
    b = Book(spark, d)
    rows = ho.nav_returns(b.nav).select("portfolio", "date", "r").join(b.index, "date").select("portfolio", "date", "r", "close")
    return r(b.stored(rows, "benchmark")("FURNITURE").orderBy("date"))


@query(sql(PRICES, "select symbol, date, round(close, 9) as close from prices where symbol in ('Brand#11', 'Brand#23')"))
def s6_price_reader(spark, d):
    """Whole price histories of two symbols, each day once."""
    b = Book(spark, d)
    read = b.stored(b.prices.select("symbol", "date", "close"), "prices", "symbol")
    return r(read("Brand#11").union(read("Brand#23")).dropDuplicates(["symbol", "date"]), 9)


@query(sql(*TO_NAV, "select portfolio, date, round(exp(sum(ln(1 + coalesce(r, 0))) over (partition by portfolio order by date)) - 1, 4) as cumulative from rets"))
def m2_cumulative_return(spark, d):
    n = ho.nav_returns(Book(spark, d).nav)
    w = st.by("portfolio").rowsBetween(Window.unboundedPreceding, 0)
    return r(n.select("portfolio", "date", (F.product(1 + F.coalesce("r", F.lit(0.0))).over(w) - 1).alias("cumulative")), 4)


@query(sql(*TO_NAV, """select portfolio, date, round(stddev_samp(r) over (partition by portfolio order by date rows 29 preceding) * sqrt(252), 6) as vol_30, round(max(nav) over w, 2) as peak, round((nav - max(nav) over w) / max(nav) over w, 6) as drawdown from rets window w as (partition by portfolio order by date)"""))
def m3_risk_metrics(spark, d):
    n = rk.drawdowns(ho.nav_returns(Book(spark, d).nav), ["portfolio"], "nav")
    vol = F.stddev_samp("r").over(st.by("portfolio").rowsBetween(-29, 0)) * st.DAYS**0.5
    return n.select("portfolio", "date", F.round(vol, 6).alias("vol_30"), F.round("peak", 2).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query(sql(*TO_MARKED, LAST, "select portfolio, symbol, round(mv / nullif(sum(mv) over (partition by portfolio), 0), 6) as weight from last_day"))
def m4_allocation_weight(spark, d):
    return r(Book(spark, d).last_day.select("portfolio", "symbol", st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight")))


BENCH = "bench as (select date, close, close / lag(close) over (order by date) - 1 as b from idx)"


@query(sql(*TO_NAV, INDEX, "select n.portfolio, n.date, round(n.r, 6) as r, round(i.close, 6) as close, round((i.close - lag(i.close) over w) / lag(i.close) over w, 6) as b from rets n join idx i on n.date = i.date window w as (partition by n.portfolio order by n.date)"))
def m5_benchmark(spark, d):
    b = Book(spark, d)
    j = ho.nav_returns(b.nav).select("portfolio", "date", "r").join(b.index, "date")
    return r(st.changes(j, ["portfolio"], "close", "b").select("portfolio", "date", "r", "close", "b"))


@query(sql(*TO_NAV, "select portfolio, round(nav, 2) as nav from nav where date = date '1998-12-31'"))
def m6_value_on_date(spark, d):
    """One day of the stored values, whose month alone is made and read."""
    b = Book(spark, d)
    return r(b.stored(b.nav_between("1998-12-01", "1998-12-31"), "value")(start="1998-12-31", end="1998-12-31").select("portfolio", "nav"), 2)


@query(sql(*TO_MARKED, "select portfolio, symbol, round(qty, 2) as qty from marked where date = (select max(date) from marked)"))
def m7_latest_holdings(spark, d):
    return r(Book(spark, d).last_day.select("portfolio", "symbol", "qty"), 2)


@query(sql(*TO_NAV, "select portfolio, date, round(nav, 2) as nav, round(r, 8) as r from rets order by date desc, portfolio limit 5"))
def m8_latest_values(spark, d):
    n = ho.nav_returns(Book(spark, d).nav).orderBy(F.desc("date"), "portfolio").limit(5)
    return n.select("portfolio", "date", F.round("nav", 2).alias("nav"), F.round("r", 8).alias("r"))


@query(sql(*TO_LEDGER, "select portfolio, symbol, date, kind, qty, round(price, 9) as price, row_idx from ledger"))
def m9_audit_trail(spark, d):
    return Book(spark, d).ledger.select("portfolio", "symbol", "date", "kind", "qty", F.round("price", 9).alias("price"), "row_idx").orderBy("date", "portfolio", "symbol", "row_idx")


@query(sql(*TO_MARKED, LAST, "select c.portfolio, round(m.mv, 2) as mv, m.n_held from (select distinct c_mktsegment as portfolio from customer) c left join (select portfolio, sum(mv) as mv, count(*) filter (qty > 1e-9) as n_held from last_day group by 1) m using (portfolio)"))
def m10_portfolio_catalogue(spark, d):
    g = Book(spark, d).last_day.groupBy("portfolio").agg(F.sum("mv").alias("mv"), F.count_if(F.col("qty") > 1e-9).alias("n_held"))
    return r(table(spark, d, "customer").select(F.col("c_mktsegment").alias("portfolio")).distinct().join(g, "portfolio", "left"), 2)


# ---- performance

REALIZED = """tstate as (
  select portfolio, symbol, rn, case when kind = 'BUY' then qty else -qty end as q, case when kind = 'BUY' then price * qty + fees else 0 end as c, 0::double as gain from tl where rn = 1
  union all
  select t.portfolio, t.symbol, t.rn, s.q + case when t.kind = 'BUY' then t.qty else -t.qty end,
    case when t.kind = 'BUY' then s.c + t.price * t.qty + t.fees when s.q - t.qty <= 1e-9 then 0 else s.c * (1 - t.qty / s.q) end,
    case when t.kind = 'SELL' then t.price * t.qty - t.fees - t.tax - s.c * t.qty / s.q else 0 end
  from tstate s join tl t on t.portfolio = s.portfolio and t.symbol = s.symbol and t.rn = s.rn + 1),
realized as (select portfolio, sum(gain) as realized_pnl from tstate group by 1)"""
TL = "tl as materialized (select *, row_number() over (partition by portfolio, symbol order by row_idx) as rn from ledger)"
DEPLOYED = "deployed as (select portfolio, sum(case when kind = 'BUY' then price * qty + fees else 0 end) as deployed from ledger group by 1)"


@query(sql(*TO_LEDGER, TL, REALIZED, DEPLOYED, "select portfolio, round(realized_pnl, 1) as realized_pnl, round(deployed, 1) as deployed from realized join deployed using (portfolio)"))
def p2_realized_pnl(spark, d):
    return r(ho.realized(Book(spark, d).ledger), 1)


def _capital(b):
    return b.last_nav.join(ho.realized(b.ledger), "portfolio").withColumnRenamed("cost", "invested")


@query(sql(*TO_NAV, "select portfolio, round(mv - cost, 2) as absolute, round((mv - cost) / nullif(cost, 0), 6) as relative from nav where date = (select day from as_of)"))
def p1_capital_summary(spark, d):
    b = Book(spark, d)
    return pf.capital_summary(_capital(b)).select("portfolio", F.round("absolute", 2).alias("absolute"), F.round("relative", 6).alias("relative"))


@query(sql(*TO_NAV, """g as (select portfolio, first(nav order by date) as v0, last(nav order by date) as v1, date_diff('day', min(date), max(date)) as days from nav group by 1)
select portfolio, round(v0, 2) as v0, round(v1, 2) as v1, days, round(pow(v1 / v0, 365.25 / days) - 1, 6) as cagr, round(pow(1 + (v1 / v0 - 1), 365.25 / days) - 1, 6) as annualized from g"""))
def p3_p4_growth(spark, d):
    g = pf.growth(Book(spark, d).nav, ["portfolio"], "nav")
    return g.select("portfolio", F.round("v0", 2).alias("v0"), F.round("v1", 2).alias("v1"), "days", F.round("cagr", 6).alias("cagr"), F.round("annualized", 6).alias("annualized"))


def _periodic(unit: str, label: str) -> str:
    return sql(PRICES, f"""ret as (select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as r from prices),
span as (select symbol, unnest(generate_series(date_trunc('{unit}', min(date)), date_trunc('{unit}', max(date)), interval 1 {unit})) as p from ret group by 1),
got as (select symbol, date_trunc('{unit}', date) as p, product(1 + r) - 1 as x from ret where r is not null group by 1, 2)
select s.symbol, cast({label} as date) as period_end, round(coalesce(x, 0), 6) as ret from span s left join got g on g.symbol = s.symbol and g.p = s.p""")


def _price_returns(spark, d):
    return st.changes(ad.prices(spark, d), ["symbol"], "close")


@query(_periodic("week", "s.p + interval 6 day"))
def p5_weekly_returns(spark, d):
    return r(pf.periodic_returns(_price_returns(spark, d), ["symbol"], "W"))


@query(_periodic("month", "last_day(s.p)"))
def p5_monthly_returns(spark, d):
    return r(pf.periodic_returns(_price_returns(spark, d), ["symbol"], "ME"))


@query(_periodic("year", "s.p + interval 1 year - interval 1 day"))
def p5_yearly_returns(spark, d):
    return r(pf.periodic_returns(_price_returns(spark, d), ["symbol"], "YE"))


@query(sql(PRICES, "ret as (select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as r from prices)", "select symbol, date, round(case when count(r) over w = 21 then product(1 + r) over w - 1 end, 5) as rolling from ret window w as (partition by symbol order by date rows 20 preceding)"))
def p6_rolling_returns(spark, d):
    return r(pf.rolling_returns(_price_returns(spark, d), ["symbol"], 21).select("symbol", "date", "rolling"), 5)


FLOWS = "tf as (select portfolio, date, sum(case when kind = 'BUY' then price * qty + fees else -(price * qty - fees - tax) end) as flow from ledger group by 1, 2)"
IMPLIED = """step as (select *, coalesce(lag(qty) over w, 0) as q0, coalesce(lag(mv) over w, 0) as v0 from marked window w as (partition by portfolio, symbol order by date)),
imp as (select portfolio, date, sum(case when abs(qty - q0) <= 1e-9 then 0 when qty > 1e-9 then (qty - q0) * mv / qty else coalesce((qty - q0) * v0 / nullif(q0, 0), 0) end) as flow from step group by 1, 2),
fr as (select n.portfolio, n.date, case when lag(n.mv) over w > 0 then (n.mv - lag(n.mv) over w - coalesce(i.flow, 0)) / lag(n.mv) over w end as r from nav n left join imp i on i.portfolio = n.portfolio and i.date = n.date window w as (partition by n.portfolio order by n.date))"""


@query(sql(*TO_LEDGER, FLOWS, "select portfolio, date, round(flow + 0.000037, 3) as flow from tf"))
def p8_trade_flows(spark, d):
    return r(pf.trade_flows(Book(spark, d).ledger), 3, 0.000037)


@query(sql(*TO_NAV, IMPLIED, "select portfolio, date, round(flow + 0.00037, 2) as flow from imp"))
def p9_implied_flows(spark, d):
    return r(pf.implied_flows(Book(spark, d).marked), 2, 0.00037)


def _flow_returns(b):
    return pf.flow_returns(b.nav, pf.implied_flows(b.marked), ["portfolio"])


@query(sql(*TO_NAV, IMPLIED, "select portfolio, date, round(r, 6) as r from fr"))
def p7_flow_returns(spark, d):
    return r(_flow_returns(Book(spark, d)).select("portfolio", "date", "r"))


@query(sql(*TO_NAV, IMPLIED, "select portfolio, round(exp(sum(ln(1 + r))) - 1, 3) as twr from fr where r is not null group by 1"))
def p10_time_weighted(spark, d):
    return r(pf.time_weighted(_flow_returns(Book(spark, d)), ["portfolio"]), 3)


ICF = """icf as (select portfolio, date, sum(cf) as cf from (
  select portfolio, date, case when kind = 'BUY' then -(price * qty + fees) else price * qty - fees - tax end as cf from ledger
  union all select portfolio, date, mv from nav where date = (select day from as_of)) group by 1, 2)"""


@query(sql(*TO_NAV, ICF, "select portfolio, date, round(cf, 2) as cf from icf"))
def p12_investor_flows(spark, d):
    b = Book(spark, d)
    return r(pf.investor_flows(b.ledger, b.last_nav.withColumn("date", b.as_of)), 2)


@query(sql(*TO_NAV, ICF, """t as materialized (select portfolio, cf, date_diff('day', min(date) over (partition by portfolio), date) / 365.0 as t from icf),
bis as (select distinct portfolio, -0.9999::double as lo, 10.0::double as hi, 0 as i from t
  union all
  select b.portfolio, case when f.s * g.s > 0 then (lo + hi) / 2 else lo end, case when f.s * g.s > 0 then hi else (lo + hi) / 2 end, i + 1 from bis b,
    lateral (select sum(cf / pow(1 + (b.lo + b.hi) / 2, t)) as s from t where t.portfolio = b.portfolio) f, lateral (select sum(cf / pow(1 - 0.9999, t)) as s from t where t.portfolio = b.portfolio) g where i < 60)
select portfolio, round((lo + hi) / 2, 5) as xirr from bis where i = 60"""))
def p11_xirr(spark, d):
    b = Book(spark, d)
    return r(pf.xirr(pf.investor_flows(b.ledger, b.last_nav.withColumn("date", b.as_of))), 5)


# ---- risk, benchmark, allocation, attribution

PRET = "pret as materialized (select symbol, date, close, close / lag(close) over (partition by symbol order by date) - 1 as r from prices)"


@query(sql(PRICES, PRET, """select symbol, round(stddev_samp(r) * sqrt(252), 6) as volatility, round(sqrt(avg(pow(least(r, 0), 2))) * sqrt(252), 6) as downside, round((avg(r) * 252 - 0.07) / (stddev_samp(r) * sqrt(252)), 6) as sharpe,
  round((avg(r) * 252 - 0.07) / (sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)), 6) as sortino, round(-quantile_cont(r, 0.05), 6) as var_hist, round(-(avg(r) - 1.6448536269514722 * stddev_samp(r)), 6) as var_param from pret where r is not null group by 1"""))
def r1_r8_risk_summary(spark, d):
    return r(rk.summary(_price_returns(spark, d), ["symbol"]))


@query(sql(PRICES, PRET, INDEX, BENCH, "select symbol, round(covar_samp(r, b) / var_samp(b), 6) as beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 6) as alpha from pret join bench using (date) where r is not null and b is not null group by 1"))
def r5_beta_alpha(spark, d):
    return r(rk.beta_alpha(_price_returns(spark, d), _bench(spark, d), ["symbol"]))


def _bench(spark, d):
    i = Book(spark, d).index.withColumn("k", F.lit(1))
    return st.changes(i, ["k"], "close", "b").select("date", "b")


@query(sql(*TO_NAV, """dd as (select portfolio, date, mv, max(mv) over (partition by portfolio order by date) as peak, (mv - max(mv) over (partition by portfolio order by date)) / max(mv) over (partition by portfolio order by date) as d from nav),
lo as (select portfolio, first(date order by d, date) as trough, first(d order by d, date) as d, first(peak order by d, date) as top, max(date) as last from dd group by 1)
select l.portfolio, round(l.d, 6) as max_drawdown, max(case when x.date <= l.trough and x.mv = l.top then x.date end) as peak_date, l.trough, min(case when x.date > l.trough and x.mv >= l.top then x.date end) as recovery,
  date_diff('day', max(case when x.date <= l.trough and x.mv = l.top then x.date end), coalesce(min(case when x.date > l.trough and x.mv >= l.top then x.date end), l.last)) as days from lo l join dd x using (portfolio) group by l.portfolio, l.d, l.trough, l.last"""))
def r6_max_drawdown(spark, d):
    return r(rk.max_drawdown(Book(spark, d).nav, ["portfolio"], "mv"))


@query(sql(PRICES, PRET, "v as (select symbol, quantile_cont(r, 0.05) as q from pret where r is not null group by 1)", "select symbol, round(-avg(r), 6) as cvar from pret join v using (symbol) where r <= q group by 1"))
def r9_conditional_var(spark, d):
    return r(rk.conditional_var(_price_returns(spark, d), ["symbol"]))


@query(sql(PRICES, PRET, "select a.symbol as a, b.symbol as b, round(corr(a.r, b.r), 5) as corr, count(*) as n from pret a join pret b on a.date = b.date and a.symbol <= b.symbol where a.r is not null and b.r is not null group by 1, 2"))
def r10_correlations(spark, d):
    return r(rk.correlations(_price_returns(spark, d), [], "symbol"), 5)


HELD_SERIES = """hw as (select portfolio, symbol, mv from last_day where mv > 1e-9),
series as materialized (select h.portfolio, p.date, sum(h.mv * p.close / l.last) as value, count(*) as n, max(c.n_held) as n_held from hw h join monthly p on p.symbol = h.symbol
  join (select symbol, last(close order by date) as last from monthly group by 1) l on l.symbol = h.symbol join (select portfolio, count(*) as n_held from hw group by 1) c on c.portfolio = h.portfolio group by 1, 2 having count(*) = max(c.n_held)),
sret as materialized (select portfolio, date, value, value / lag(value) over (partition by portfolio order by date) - 1 as r from series)"""
MONTHLY_INDEX = """midx as (select last_day(date) as date, last(close order by date) as close from idx group by 1), mbench as (select date, close / lag(close) over (order by date) - 1 as b from midx)"""


def _held_series(b):
    """Monthly, as on few days every held symbol is traded."""
    return rk.current_holdings_series(b.last_day.select("portfolio", "symbol", "mv"), b.monthly)


def _monthly_bench(b):
    i = b.index.groupBy(F.last_day("date").alias("date")).agg(F.max_by("close", "date").alias("close")).withColumn("k", F.lit(1))
    return st.changes(i, ["k"], "close", "b").select("date", "b")


@query(sql(*TO_MARKED, LAST, MONTHLY, HELD_SERIES, "select portfolio, date, round(value, 2) as value from series"))
def r11_holdings_series(spark, d):
    return r(_held_series(Book(spark, d)), 2)


@query(sql(*TO_MARKED, LAST, MONTHLY, HELD_SERIES, "select portfolio, date, round(value, 2) as value from (select *, count(*) over (partition by portfolio) as c from series where date between date '1997-01-01' and date '1999-12-31') where c >= 3"))
def r12_risk_window(spark, d):
    return r(rk.in_window(_held_series(Book(spark, d)), ["portfolio"], "1997-01-01", "1999-12-31"), 2)


@query(sql(*TO_MARKED, LAST, MONTHLY, INDEX, MONTHLY_INDEX, HELD_SERIES, """x as (select * from sret where r is not null),
m as (select portfolio, stddev_samp(r) * sqrt(252) as volatility, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) as downside, avg(r) * 252 - 0.07 as over, quantile_cont(r, 0.05) as q, -(avg(r) - 1.6448536269514722 * stddev_samp(r)) as var_param from x group by 1),
cv as (select portfolio, -avg(r) as cvar from x join m using (portfolio) where r <= q group by 1),
ba as (select portfolio, covar_samp(r, b) / var_samp(b) as beta, (avg(r - 0.07 / 252) - covar_samp(r, b) / var_samp(b) * avg(b - 0.07 / 252)) * 252 as alpha from x join mbench using (date) where b is not null group by 1),
dd as (select portfolio, date, value, max(value) over w as peak, (value - max(value) over w) / max(value) over w as d from series window w as (partition by portfolio order by date)),
lo as (select portfolio, first(date order by d, date) as trough, first(d order by d, date) as d, first(peak order by d, date) as top, max(date) as last from dd group by 1),
ep as (select l.portfolio, l.d as max_drawdown, max(case when x.date <= l.trough and x.value = l.top then x.date end) as peak_date, l.trough, min(case when x.date > l.trough and x.value >= l.top then x.date end) as recovery, l.last from lo l join dd x using (portfolio) group by l.portfolio, l.d, l.trough, l.last)
select portfolio, (select min(date) from series s where s.portfolio = m.portfolio) as window_start, ep.last as window_end, round(volatility, 6) as volatility, round(downside, 6) as downside, round(over / volatility, 6) as sharpe, round(over / downside, 6) as sortino, round(-q, 6) as var_hist, round(var_param, 6) as var_param,
  round(cvar, 6) as cvar, round(beta, 6) as beta, round(alpha, 5) as alpha, round(max_drawdown, 6) as max_drawdown, peak_date, trough, recovery, date_diff('day', peak_date, coalesce(recovery, ep.last)) as days from m join cv using (portfolio) join ba using (portfolio) join ep using (portfolio)"""))
def r13_risk_report(spark, d):
    b = Book(spark, d)
    x = rk.report(staged(_held_series(b), "series"), _monthly_bench(b), ["portfolio"])
    return r(x.withColumn("alpha", F.round("alpha", 5)))


@query(sql(*TO_MARKED, LAST, MONTHLY, INDEX, MONTHLY_INDEX, """hr as (select h.portfolio, h.symbol, m.date, m.close / lag(m.close) over (partition by h.portfolio, h.symbol order by m.date) - 1 as r from last_day h join monthly m using (symbol) where h.qty > 1e-9),
al as (select portfolio, symbol, date, r from hr where r is not null union all select distinct p.portfolio, 'INDEX', b.date, b.b from (select distinct portfolio from hr) p cross join mbench b where b.b is not null)
select a.portfolio, a.symbol as a, b.symbol as b, round(corr(a.r, b.r), 5) as corr, count(*) as n from al a join al b on a.portfolio = b.portfolio and a.date = b.date and a.symbol <= b.symbol group by 1, 2, 3"""))
def r13_held_correlations(spark, d):
    """Of each portfolio's held symbols and the index."""
    b = Book(spark, d)
    held = b.last_day.where("qty > 1e-9").select("portfolio", "symbol")
    x = st.changes(held.join(b.monthly, "symbol"), ["portfolio", "symbol"], "close").select("portfolio", "symbol", "date", "r")
    index = held.select("portfolio").distinct().withColumn("symbol", F.lit("INDEX")).join(_monthly_bench(b).withColumnRenamed("b", "r").withColumn("symbol", F.lit("INDEX")), "symbol").select("portfolio", "symbol", "date", "r")
    return r(rk.correlations(x.unionByName(index), ["portfolio"], "symbol"), 5)


@query(sql(*TO_MARKED, LAST, SECTORS, """x as (select l.portfolio, l.symbol, s.sector, s.industry, s.currency, l.mv from last_day l join sectors s using (symbol)),
g as (select portfolio, 'symbol' as dimension, symbol as name, sum(mv) as mv from x group by 1, 3 union all select portfolio, 'sector', sector, sum(mv) from x group by 1, 3 union all select portfolio, 'industry', industry, sum(mv) from x group by 1, 3 union all select portfolio, 'currency', currency, sum(mv) from x group by 1, 3)
select portfolio, dimension, name, round(mv, 2) as mv, round(mv / sum(mv) over (partition by portfolio, dimension), 6) as weight from g"""))
def a1_breakdowns(spark, d):
    b = Book(spark, d)
    return al.breakdown(b.last_day.join(b.sectors, "symbol"), ["symbol", "sector", "industry", "currency"]).select("portfolio", "dimension", "name", F.round("mv", 2).alias("mv"), F.round("weight", 6).alias("weight"))


@query(sql(*TO_NAV, "select portfolio, round(mv / (mv + cash), 6) as holdings_pct, round(cash / (mv + cash), 6) as cash_pct from nav where date = (select day from as_of)"))
def a2_cash_split(spark, d):
    b = Book(spark, d)
    return r(al.cash_split(b.last_nav))


A6 = """w as (select portfolio, symbol, mv / sum(mv) over (partition by portfolio) as weight from last_day where qty > 1e-9),
n as (select *, row_number() over (partition by portfolio order by weight desc, symbol) as n from w)
select portfolio, round(max(weight), 6) as largest, round(sum(weight) filter (n <= 5), 6) as top_n, round(sum(weight * weight), 6) as hhi from n group by 1"""


@query(sql(*TO_MARKED, LAST, A6))
def a3_a5_concentration(spark, d):
    h = Book(spark, d).last_day.where("qty > 1e-9")
    w = h.select("portfolio", F.col("symbol").alias("name"), st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight"))
    return r(al.concentration(w))


A6_REPORT = """h as (select l.portfolio, l.symbol, s.sector, s.currency, l.mv from last_day l join sectors s using (symbol) where l.mv > 1e-9),
g as (select portfolio, 'symbol' as section, symbol as name, sum(mv) as mv from h group by 1, 3 union all select portfolio, 'sector', sector, sum(mv) from h group by 1, 3 union all select portfolio, 'currency', currency, sum(mv) from h group by 1, 3),
w as (select portfolio, section, name, mv / sum(mv) over (partition by portfolio, section) as value from g),
c as (select portfolio, mv / (mv + cash) as holdings_pct, cash / (mv + cash) as cash_pct from nav where date = (select day from as_of)),
k as (select *, row_number() over (partition by portfolio order by value desc, name) as n from w where section = 'symbol')
select portfolio, section, name, round(value, 6) as value from (select * from w union all select portfolio, 'cash', 'holdings_pct', holdings_pct from c union all select portfolio, 'cash', 'cash_pct', cash_pct from c
  union all select portfolio, 'concentration', 'largest', max(value) from k group by 1 union all select portfolio, 'concentration', 'top_n', sum(value) filter (n <= 2) from k group by 1 union all select portfolio, 'concentration', 'hhi', sum(value * value) from k group by 1)"""


@query(sql(*TO_NAV, LAST, SECTORS, A6_REPORT))
def a6_allocation_report(spark, d):
    b = Book(spark, d)
    held = b.last_day.where("mv > 1e-9").join(b.sectors, "symbol")
    return r(al.report(held, b.last_nav, ["symbol", "sector", "currency"]))


@query(sql(*TO_NAV, LAST, """t as (select portfolio, sum(mv) as mv, sum(cost) as invested from last_day group by 1),
w as (select portfolio, symbol, mv / sum(mv) over (partition by portfolio) as weight from last_day where mv > 1e-9)
select t.portfolio, round(t.invested, 2) as invested, round(t.mv, 2) as mv, round(t.mv - t.invested, 2) as absolute, round((t.mv - t.invested) / nullif(t.invested, 0), 6) as relative, symbol, round(weight, 6) as weight from t left join w using (portfolio)"""))
def a7_overview(spark, d):
    """Totals of all positions, and the list of those held; what is read twice is written, a few rows each."""
    b = Book(spark, d)
    b.prices = staged(b.prices, "prices")
    totals = staged(_capital(b), "capital")
    totals = totals.select("portfolio", "invested", "mv").join(pf.capital_summary(totals), "portfolio")
    held = b.last_day.where("mv > 1e-9").select("portfolio", "symbol", st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight"))
    x = totals.join(held, "portfolio", "left").select("portfolio", "invested", "mv", "absolute", "relative", "symbol", "weight")
    return r(x.withColumns({c: F.round(c, 2) for c in ("invested", "mv", "absolute")}))


@query(sql(PRICES, PRET, INDEX, BENCH, "select symbol, date, round(r - b, 8) as excess from pret join bench using (date) where r is not null and b is not null"))
def b1_excess_return(spark, d):
    return r(al.excess(_price_returns(spark, d), _bench(spark, d)).select("symbol", "date", "excess"), 8)


@query(sql(PRICES, PRET, INDEX, BENCH, """x as (select symbol, r, b, r - b as e from pret join bench using (date) where r is not null and b is not null)
select symbol, round(product(1 + r) - 1, 4) as cum_portfolio, round(product(1 + b) - 1, 4) as cum_benchmark, round(product(1 + r) - product(1 + b), 4) as cum_excess, round(stddev_samp(e) * sqrt(252), 6) as tracking_error, round(avg(e) * 252 / (stddev_samp(e) * sqrt(252)), 6) as information_ratio,
  round(covar_samp(r, b) / var_samp(b), 6) as beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 6) as alpha, round(corr(r, b), 6) as corr from x group by 1"""))
def b2_b4_comparison(spark, d):
    c = al.compare(_price_returns(spark, d), _bench(spark, d), ["symbol"])
    return r(c.withColumns({k: F.round(k, 4) for k in ("cum_portfolio", "cum_benchmark", "cum_excess")}))


@query(sql(*TO_NAV, INDEX, BENCH, """x as (select portfolio, r, b, r - b as e from rets join bench using (date) where r is not null and b is not null),
t as (select portfolio, (mv - cost) / nullif(cost, 0) as total from nav where date = (select day from as_of))
select portfolio, round(max(total), 6) as cum_portfolio, round(product(1 + b) - 1, 4) as cum_benchmark, round(max(total) - product(1 + b) + 1, 4) as cum_excess, round(stddev_samp(e) * sqrt(252), 5) as tracking_error, round(avg(e) * 252 / (stddev_samp(e) * sqrt(252)), 6) as information_ratio, round(corr(r, b), 6) as corr from x join t using (portfolio) group by 1"""))
def b4_headline(spark, d):
    """Portfolios against the index, with the return on invested capital as the headline."""
    b = Book(spark, d)
    b.prices = staged(b.prices, "prices")
    total = staged(pf.capital_summary(_capital(b)).select("portfolio", F.col("relative").alias("total")), "capital")
    c = al.compare(ho.nav_returns(b.nav), _bench(spark, d), ["portfolio"], headline=total)
    return r(c.select("portfolio", "cum_portfolio", F.round("cum_benchmark", 4).alias("cum_benchmark"), F.round("cum_excess", 4).alias("cum_excess"), F.round("tracking_error", 5).alias("tracking_error"), "information_ratio", "corr"))


ATTR = """sw as (select portfolio, symbol, mv / sum(mv) over (partition by portfolio) as weight from marked where date = date '1998-01-01'),
pr as (select a.symbol, b.close / a.close - 1 as ret from (select symbol, last(close order by date) as close from prices where date <= date '1998-01-01' group by 1) a join (select symbol, last(close order by date) as close from prices where date <= date '1998-06-30' group by 1) b using (symbol)),
ct as (select s.portfolio, s.symbol, s.weight, p.ret, s.weight * p.ret as contribution from sw s join pr p using (symbol))"""


def _contributions(spark, d):
    b = Book(spark, d)
    day = b.stored(b.marked_between("1998-01-01", "1998-01-31"), "assets")(start="1998-01-01", end="1998-01-01")
    w = day.select("portfolio", "symbol", st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight"))
    at = lambda day, name: b.prices.where(f"date <= '{day}'").groupBy("symbol").agg(F.max_by("close", "date").alias(name))
    ret = at("1998-01-01", "a").join(at("1998-06-30", "b"), "symbol").select("symbol", (F.col("b") / F.col("a") - 1).alias("ret"))
    return al.contributions(w, ret), b


@query(sql(*TO_MARKED, ATTR, "select portfolio, symbol, round(weight, 6) as weight, round(ret, 6) as ret, round(contribution, 6) as contribution from ct"))
def t1_asset_contribution(spark, d):
    return r(_contributions(spark, d)[0].select("portfolio", "symbol", "weight", "ret", "contribution"))


@query(sql(*TO_MARKED, ATTR, SECTORS, "select portfolio, sector, round(sum(contribution), 6) as contribution from ct join sectors using (symbol) group by 1, 2"))
def t2_sector_contribution(spark, d):
    c, b = _contributions(spark, d)
    return r(c.join(b.sectors, "symbol").groupBy("portfolio", "sector").agg(F.sum("contribution").alias("contribution")))


@query(sql(*TO_MARKED, ATTR, "select portfolio, round(sum(contribution), 6) as total, true as reconciles from ct group by 1"))
def t3_total_contribution(spark, d):
    c, _ = _contributions(spark, d)
    end = F.sum(F.col("weight") * (1 + F.col("ret"))) / F.sum("weight") - 1
    return r(c.groupBy("portfolio").agg(F.sum("contribution").alias("total"), (F.abs(F.sum("contribution") - end) < 1e-9).alias("reconciles")))


TO_FINE = (RAW_FINE, *TO_LEDGER[1:])
QUIET = """few as (select portfolio, date from ledger group by 1, 2),
gaps as (select portfolio, date, lead(date) over (partition by portfolio order by date) as nxt from few),
quiet as (select portfolio, first(date order by nxt - date desc, date) as start, first(nxt order by nxt - date desc, date) - 1 as "end" from gaps where nxt is not null group by 1 having start < "end")"""


@query(sql(*TO_FINE, QUIET, 'select portfolio, start, "end" from quiet'))
def t4_quiet_window(spark, d):
    """Portfolios here are segments by nation, so that some days pass between trades."""
    return al.quiet_window(Book(spark, d, fine=True).ledger)


@query(sql(*TO_FINE, QUIET, "select portfolio, count(*) as n, min(date) as first, max(date) as last from few where date > date '1997-01-01' and date < date '1997-03-01' group by 1"))
def t5_trades_in_window(spark, d):
    t = al.trades_inside(Book(spark, d, fine=True).ledger, "1997-01-01", "1997-03-01")
    return t.select("portfolio", F.size("dates").cast("long").alias("n"), F.array_min("dates").alias("first"), F.array_max("dates").alias("last"))


@query(sql(*TO_FINE, *TO_HELD[2:], PRICES, QUIET, SECTORS, """st as (select q.portfolio, h.symbol, q.start, q."end", h.qty from quiet q join (select distinct portfolio, symbol from held) k using (portfolio) asof join held h on k.portfolio = h.portfolio and k.symbol = h.symbol and q.start >= h.date),
c0 as (select st.*, p.close as c0 from st asof left join prices p on st.symbol = p.symbol and st.start >= p.date), c1 as (select c0.*, p.close as c1 from c0 asof left join prices p on c0.symbol = p.symbol and c0."end" >= p.date),
x as (select *, qty * c0 / sum(qty * c0) over (partition by portfolio) as weight, c1 / c0 - 1 as ret, sum(qty * c1) over (partition by portfolio) / sum(qty * c0) over (partition by portfolio) - 1 as actual from c1)
select portfolio, start, "end", symbol, sector, round(weight, 6) as weight, round(ret, 6) as ret, round(weight * ret, 6) as contribution, round(sum(weight * ret) over (partition by portfolio, sector), 6) as sector_contribution, round(sum(weight * ret) over (partition by portfolio), 6) as total, round(actual, 6) as actual from x join sectors using (symbol)"""))
def t6_attribution_report(spark, d):
    b = Book(spark, d, fine=True)
    closes = tp.carry(b.prices, ["symbol"], "date", b.as_of, ["close"])
    return r(al.attribution(b.marked, closes, al.quiet_window(b.ledger), b.sectors))


# ---- scenario summaries and forecasts: a symbol's monthly values are its paths by year

PATHS = """paths as materialized (select symbol, cast(year(date) as bigint) as path_id, cast(month(date) as integer) as step, avg(close) as value from prices group by 1, 2, 3)"""


def _paths(spark, d):
    return ad.prices(spark, d).groupBy("symbol", F.year("date").cast("long").alias("path_id"), F.month("date").alias("step")).agg(F.avg("close").alias("value"))


@query(sql(PRICES, PRET, """g as (select symbol, stddev_samp(r) * sqrt(252) as sigma, pow(last(close order by date) / first(close order by date), 365.25 / date_diff('day', min(date), max(date))) - 1 as cagr from pret group by 1)
select symbol, round(sigma, 6) as sigma, round(cagr, 6) as cagr, round(ln(1 + cagr) + sigma * sigma / 2, 5) as mu from g"""))
def g1_calibration(spark, d):
    p = _price_returns(spark, d)
    v = p.groupBy("symbol").agg(st.annual_vol("r").alias("sigma")).join(pf.growth(p, ["symbol"], "close"), "symbol")
    return v.select("symbol", F.round("sigma", 6).alias("sigma"), F.round("cagr", 6).alias("cagr"), F.round(F.log1p("cagr") + F.col("sigma") * F.col("sigma") / 2, 5).alias("mu"))


G2 = """k as (select *, count(*) over (partition by date) as n from monthly), q as (select symbol, date, close, close / lag(close) over (partition by symbol order by date) - 1 as r from k where n = (select count(distinct symbol) from monthly))"""


def _common(b):
    """Monthly closes of the months in which every symbol was priced, with returns."""
    m = b.monthly
    every = m.groupBy("date").agg(F.count("*").alias("n")).join(m.agg(F.countDistinct("symbol").alias("n")), "n").select("date")
    return st.changes(m.join(every, "date"), ["symbol"], "close")


@query(sql(*TO_MARKED, LAST, MONTHLY, G2, """g as (select symbol, stddev_samp(r) * sqrt(252) as sigma, pow(last(close order by date) / first(close order by date), 365.25 / date_diff('day', min(date), max(date))) - 1 as cagr from q group by 1)
select portfolio, symbol, round(mv / sum(mv) over (partition by portfolio), 6) as weight, round(sigma, 6) as sigma, round(cagr, 6) as cagr, round(ln(1 + cagr) + sigma * sigma / 2, 5) as mu from last_day join g using (symbol)"""))
def g2_asset_calibration(spark, d):
    b = Book(spark, d)
    q = _common(b)
    v = q.groupBy("symbol").agg(st.annual_vol("r").alias("sigma")).join(pf.growth(q, ["symbol"], "close"), "symbol")
    v = v.select("symbol", "sigma", "cagr", F.round(F.log1p("cagr") + F.col("sigma") * F.col("sigma") / 2, 5).alias("mu"))
    w = b.last_day.select("portfolio", "symbol", st.ratio(F.col("mv"), F.sum("mv").over(Window.partitionBy("portfolio"))).alias("weight"))
    return r(w.join(v, "symbol").select("portfolio", "symbol", "weight", "sigma", "cagr", "mu"))


@query(sql(PRICES, MONTHLY, G2, "select a.symbol as a, b.symbol as b, round(corr(a.r, b.r), 6) as corr, count(*) as n from q a join q b on a.date = b.date and a.symbol <= b.symbol where a.r is not null and b.r is not null group by 1, 2"))
def g2_asset_correlations(spark, d):
    return r(rk.correlations(_common(Book(spark, d)), [], "symbol"))


@query(sql(PRICES, PATHS, """t as (select symbol, path_id, last(value order by step) as v, first(value order by step) as s0 from paths group by 1, 2),
x as (select *, v / s0 - 1 as ret, quantile_cont(v / s0 - 1, 0.05) over (partition by symbol) as q from t)
select symbol, round(quantile_cont(v, 0.05), 4) as p5, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, round(quantile_cont(v, 0.95), 4) as p95,
  round(avg((v < s0)::int), 6) as p_loss, round(avg((v > s0 * 1.1)::int), 6) as p_gain_10, round(-max(q), 4) as var, round(-avg(ret) filter (ret <= q), 4) as shortfall from x group by 1"""))
def g3_g5_path_summary(spark, d):
    s = fc.path_summary(_paths(spark, d), ["symbol"])
    return s.select(*[F.round(c, 6 if c.startswith("p_") else 4).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(sql(PRICES, PATHS, """dd as (select symbol, path_id, (value - max(value) over w) / max(value) over w as d from paths window w as (partition by symbol, path_id order by step)), e as (select symbol, path_id, min(d) as d from dd group by 1, 2)
select symbol, round(avg(d), 6) as mean_dd, round(quantile_cont(d, 0.5), 6) as median_dd, round(quantile_cont(d, 0.05), 6) as p5_dd, round(min(d), 6) as worst_dd from e group by 1"""))
def g6_path_drawdowns(spark, d):
    return r(fc.path_drawdowns(_paths(spark, d), ["symbol"]))


DIFFS = "df as materialized (select symbol, date, close, close - lag(close) over (partition by symbol order by date) as d, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n from prices)"


@query(sql(PRICES, DIFFS, """g as (select symbol, last(close order by date) as last, avg(d) as drift, stddev_pop(d) as sigma from df group by 1), h as (select *, unnest(range(1, 31))::int as h from g)
select symbol, h, round(last + h * drift, 3) as point, round(last + h * drift - 1.2815515655446008 * sigma * sqrt(h), 3) as low_80, round(last + h * drift + 1.2815515655446008 * sigma * sqrt(h), 3) as high_80,
  round(last + h * drift - 1.959963984540054 * sigma * sqrt(h), 3) as low_95, round(last + h * drift + 1.959963984540054 * sigma * sqrt(h), 3) as high_95 from h"""))
def f1_drift_forecast(spark, d):
    return r(fc.drift_forecast(ad.prices(spark, d), ["symbol"], 30, "close"), 3)


BACK = """bt as (select symbol, date, i, n, close, avg(d) over w as drift, stddev_pop(d) over w as sigma, lead(close, 21) over (partition by symbol order by date) as actual from df window w as (partition by symbol order by date)),
og as (select *, close + 21 * drift as point from bt where n > 122 and i in (select cast(floor(100 + (bt.n - 22 - 100) * k / 4.0) as bigint) from range(0, 5) t(k)))"""


@query(sql(PRICES, DIFFS, BACK, "select symbol, date, i, round(point, 3) as point, round(actual, 3) as actual, abs(actual - point) <= 1.2815515655446008 * sigma * sqrt(21) as in_80, abs(actual - point) <= 1.959963984540054 * sigma * sqrt(21) as in_95 from og"))
def f2_backtest(spark, d):
    return r(fc.backtest(ad.prices(spark, d), ["symbol"], 21, value="close"), 3)


@query(sql(PRICES, DIFFS, BACK, "select symbol, count(*) as n_origins, round(avg(abs(actual - point)), 3) as mae, round(sqrt(avg(pow(actual - point, 2))), 3) as rmse, avg((abs(actual - point) <= 1.2815515655446008 * sigma * sqrt(21))::int) as coverage_80, avg((abs(actual - point) <= 1.959963984540054 * sigma * sqrt(21))::int) as coverage_95 from og group by 1"))
def f2_backtest_summary(spark, d):
    return r(fc.backtest_summary(fc.backtest(ad.prices(spark, d), ["symbol"], 21, value="close"), ["symbol"]), 3)


@query(sql(PRICES, "l as (select symbol, count(*) as n from prices group by 1 union all select symbol || '/' || year(date), count(*) from prices group by 1)", "select symbol, n, least(252, greatest(30, cast(floor((n - 253) / 2.0) as bigint))) as min_train, case when n - 253 < 30 then 0 else least(5, n - 253 - least(252, greatest(30, cast(floor((n - 253) / 2.0) as bigint))) + 1) end as n_origins from l"))
def f3_adaptive_plan(spark, d):
    lengths = ad.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).union(ad.prices(spark, d).groupBy(F.concat("symbol", F.lit("/"), F.year("date"))).agg(F.count("*")))
    return fc.adaptive_plan(lengths, 252)


@query(sql(PRICES, PATHS, DIFFS, """g as (select symbol, last(close order by date) + 252 * avg(d) as point from df group by 1), t as (select symbol, path_id, last(value order by step) as v from paths group by 1, 2),
b as (select symbol, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.95) as p95 from t group by 1)
select symbol, case when point between p25 and p75 then 'agree' when point < p5 or point > p95 then 'disagree' else 'moderate' end as verdict from g join b using (symbol)"""))
def f4_method_comparison(spark, d):
    point = fc.drift_forecast(ad.prices(spark, d), ["symbol"], 252, "close").where("h = 252").select("symbol", "point")
    return fc.agreement(fc.path_summary(_paths(spark, d), ["symbol"]).join(point, "symbol")).select("symbol", "verdict")


@query(sql(PRICES, "x as (select symbol, close from prices qualify row_number() over (partition by symbol order by date desc) <= 20)", "select symbol, round(avg(close), 6) as point from x group by 1"))
def f5_custom_forecaster(spark, d):
    def mean_of_last(pdf):
        pdf = pdf.sort_values("date").tail(20)
        return pdf.groupby("symbol", as_index=False)["close"].mean().rename(columns={"close": "point"})

    return r(fc.forecast_with(ad.prices(spark, d).select("symbol", "date", "close"), ["symbol"], mean_of_last, "symbol string, point double"))


# ---- volatility regimes


def _full(expr: str, n: int, what: str = "r") -> str:
    return f"case when count({what}) over w{n} = {n} then {expr} end"


FEATS = PRET.replace("select symbol, date, close,", "select symbol, date, close, volume,") + f""",
feats as materialized (select symbol, date, close, volume, r as ret_1, close / lag(close, 5) over w - 1 as ret_5, close / lag(close, 21) over w - 1 as ret_21,
  {_full("stddev_samp(r) over w10", 10)} * sqrt(252) as vol_10, {_full("stddev_samp(r) over w21", 21)} * sqrt(252) as vol_21, {_full("stddev_samp(r) over w63", 63)} * sqrt(252) as vol_63,
  close / lag(close, 10) over w - 1 as mom_10, close / lag(close, 21) over w - 1 as mom_21, {_full("avg(close) over w20", 20, "close")} as ma_20, {_full("avg(close) over w50", 50, "close")} as ma_50,
  close / {_full("avg(close) over w20", 20, "close")} as price_ma_20, close / {_full("avg(close) over w50", 50, "close")} as price_ma_50,
  {_full("(volume - avg(volume) over w21) / nullif(stddev_samp(volume) over w21, 0)", 21, "volume")} as volume_z_21, {_full("(close - max(close) over w60) / max(close) over w60", 60, "close")} as drawdown_60,
  case when count(r) over f21 = 21 then stddev_samp(r) over f21 end * sqrt(252) as vol_forward
  from pret window w as (partition by symbol order by date), w10 as (partition by symbol order by date rows 9 preceding), w20 as (partition by symbol order by date rows 19 preceding), w21 as (partition by symbol order by date rows 20 preceding),
    w50 as (partition by symbol order by date rows 49 preceding), w60 as (partition by symbol order by date rows 59 preceding), w63 as (partition by symbol order by date rows 62 preceding), f21 as (partition by symbol order by date rows between 1 following and 21 following))"""
RANKS = "ranks as materialized (select date, row_number() over (order by date) - 1 as rank, count(*) over () as n from (select distinct date from prices))"
LABELS = RANKS + """,
th as (select symbol, quantile_cont(vol_21, 0.75) as threshold from feats where date <= (select date from ranks where rank = floor(n * 0.7) - 1) group by 1),
lab as materialized (select f.*, threshold, cast(case when vol_forward is not null then vol_forward > threshold end as int) as label, cast(case when vol_21 is not null then vol_21 > threshold end as int) as baseline from feats f join th using (symbol))"""
SPLIT = "sp as (select date, case when rank < floor(n * 0.7) then 'train' when rank < floor(n * (0.7::double + 0.15::double)) then 'val' else 'test' end as split from ranks)"


@query(sql(PRICES, FEATS, "select symbol, date, " + ", ".join(f"round({c}, 5) as {c}" for c in rg.FEATURES) + " from feats"))
def l1_l7_features(spark, d):
    f = rg.features(ad.prices(spark, d))
    return f.select("symbol", "date", *[F.round(c, 5).alias(c) for c in rg.FEATURES])


@query(sql(PRICES, FEATS, "select symbol, date, round(vol_forward, 5) as vol_forward from feats"))
def l8_forward_volatility(spark, d):
    return r(rg.forward_vol(rg.features(ad.prices(spark, d))).select("symbol", "date", "vol_forward"), 5)


@query(sql(PRICES, RANKS, "select date as cutoff from ranks where rank = floor(n * 0.7) - 1"))
def l9_cutoff_date(spark, d):
    return rg.cutoff_date(ad.prices(spark, d))


@query(sql(PRICES, FEATS, LABELS, "select symbol, date, round(threshold, 5) as threshold, label, baseline from lab"))
def l10_l15_labels(spark, d):
    return r(rg.labelled(ad.prices(spark, d)).select("symbol", "date", "threshold", "label", "baseline"), 5)


@query(sql(PRICES, FEATS, LABELS, "select symbol, date, label, baseline, " + ", ".join(f"round({c}, 5) as {c}" for c in rg.FEATURES) + " from lab where label is not null and " + " and ".join(f"{c} is not null" for c in rg.FEATURES)))
def l12_dataset(spark, d):
    return r(rg.dataset(ad.prices(spark, d)).select("symbol", "date", "label", "baseline", *rg.FEATURES), 5)


@query(sql(PRICES, RANKS, SPLIT, "select date, split from sp"))
def l13_split(spark, d):
    return rg.splits(ad.prices(spark, d))


@query(sql(PRICES, RANKS, "b as (select date, (select count(*) from range(1, 7) e(j) where floor(n * j / 6.0) <= rank) as block from ranks)", "select cast(k as integer) as fold, date, case when block < k then 'train' else 'test' end as part from b, range(1, 6) t(k) where block <= k"))
def l14_folds(spark, d):
    return rg.folds(ad.prices(spark, d))


@query(sql(PRICES, FEATS, LABELS, SPLIT, "select split, avg(label) as label_rate, count(*) as n, sum(1 - label) / nullif(sum(label), 0)::double as class_weight from lab join sp using (date) where label is not null group by 1"))
def l16_l21_label_rates(spark, d):
    x = rg.labelled(ad.prices(spark, d)).where("label is not null").join(rg.splits(ad.prices(spark, d)), "date")
    return x.groupBy("split").agg(F.avg("label").alias("label_rate"), F.count("*").alias("n"), st.ratio(F.sum(1 - F.col("label")), F.sum("label")).alias("class_weight"))


METRICS = """mt as (select split, sum(label * baseline) as tp, sum(baseline) as pp, sum(label) as pos, count(*) as n from ev group by 1),
au as (select split, sum((1 - label) * (cp - lp / 2.0)) as wins from (select e.split, e.label, e.vol_21, c.cp, c.lp from ev e join (select split, vol_21, lp, sum(lp) over (partition by split order by vol_21 desc) as cp from (select split, vol_21, sum(label) as lp from ev group by 1, 2)) c on c.split = e.split and c.vol_21 = e.vol_21) group by 1),
apr as (select split, sum(lp * cp / cc) as ap from (select split, lp, sum(lp) over (partition by split order by vol_21 desc) as cp, sum(c) over (partition by split order by vol_21 desc) as cc from (select split, vol_21, sum(label)::double as lp, count(*)::double as c from ev group by 1, 2)) group by 1)"""
EV = "ev as materialized (select split, label, baseline, vol_21 from lab join sp using (date) where label is not null and baseline is not null)"


@query(sql(PRICES, FEATS, LABELS, SPLIT, EV, METRICS, """select split, round(tp / pp::double, 6) as precision, round(tp / pos::double, 6) as recall, round(2.0 * tp / (pp + pos), 6) as f1, round(wins / (pos * (n - pos)), 6) as roc_auc, round(ap / pos, 6) as pr_auc from mt join au using (split) join apr using (split)"""))
def l18_baseline_metrics(spark, d):
    x = rg.labelled(ad.prices(spark, d)).where("label is not null and baseline is not null").join(rg.splits(ad.prices(spark, d)), "date")
    return r(rg.binary_metrics(x, ["split"], predicted="baseline", score="vol_21"))


def _metrics(pred: str, score: str, p: str) -> str:
    """Metrics of one rule by split, as tables named with the prefix."""
    return f"""{p}m as (select split, sum(label * {pred}) as tp, sum({pred}) as pp, sum(label) as pos from ev2 group by 1),
{p}a as (select split, sum(lp * cp / cc) as ap from (select split, lp, sum(lp) over (partition by split order by {score} desc) as cp, sum(c) over (partition by split order by {score} desc) as cc from (select split, {score}, sum(label)::double as lp, count(*)::double as c from ev2 group by 1, 2)) group by 1),
{p}r as (select split, 2.0 * tp / (pp + pos) as f1, ap / pos as pr_auc from {p}m join {p}a using (split))"""


@query(sql(PRICES, FEATS, LABELS, SPLIT, "ev2 as materialized (select split, label, baseline, vol_21, vol_63, cast(vol_63 > threshold as int) as slow from lab join sp using (date) where label is not null and baseline is not null and vol_63 is not null)", _metrics("baseline", "vol_21", "b"), _metrics("slow", "vol_63", "s"),
    "select split, round(s.f1 - b.f1, 6) as delta_f1, round(s.pr_auc - b.pr_auc, 6) as delta_pr_auc, s.f1 > b.f1 and s.pr_auc > b.pr_auc as better from br b join sr s using (split)"))
def l19_baseline_comparison(spark, d):
    """A slower rule (volatility of 63 days) against the persistence baseline; l17 compares the trained model."""
    x = rg.labelled(ad.prices(spark, d)).where("label is not null and baseline is not null and vol_63 is not null").join(rg.splits(ad.prices(spark, d)), "date").withColumn("slow", (F.col("vol_63") > F.col("threshold")).cast("int"))
    slow, base = rg.binary_metrics(x, ["split"], predicted="slow", score="vol_63"), rg.binary_metrics(x, ["split"], predicted="baseline", score="vol_21")
    return r(rg.against_baseline(slow, base, ["split"]).select("split", "delta_f1", "delta_pr_auc", "better"))


def _scored(rows, train: str, test: str, keys: list[str]):
    """Metrics of trees trained on some rows over others, and what they gain on the baseline."""
    from pyspark.ml.functions import vector_to_array

    made, model = rg.train_trees(rows.where(train))
    out = model.transform(made.transform(rows.where(test))).withColumn("predicted", F.col("prediction").cast("int")).withColumn("score", vector_to_array("probability")[1])
    base = rg.binary_metrics(out, keys, predicted="baseline", score="vol_21")
    return rg.against_baseline(rg.binary_metrics(out, keys, score="score"), base, keys)


@query()
def l17_boosted_trees(spark, d):
    x = staged(rg.dataset(ad.prices(spark, d)).join(rg.splits(ad.prices(spark, d)), "date"), "regimes")
    return r(_scored(x, "split = 'train'", "split <> 'train'", ["split"]))


@query()
def l20_walk_forward(spark, d):
    """Five expanding folds, each fitted on the cluster, side by side; folds with one class are skipped."""
    x = staged(rg.dataset(ad.prices(spark, d)).join(rg.folds(ad.prices(spark, d)), "date"), "folds")
    seen = x.groupBy("fold").agg(F.countDistinct(F.when(F.col("part") == "train", F.col("label"))).alias("a"), F.countDistinct(F.when(F.col("part") == "test", F.col("label"))).alias("b"))
    some = [row[0] for row in seen.where("a = 2 and b = 2").orderBy("fold").collect()]
    with ThreadPoolExecutor(5) as pool:
        found = list(pool.map(lambda k: _scored(x.where(F.col("fold") == k), "part = 'train'", "part = 'test'", ["fold"]), some))
    out = spark.createDataFrame([], "fold int, precision double, recall double, f1 double, roc_auc double, pr_auc double, delta_f1 double, delta_pr_auc double, better boolean")
    for m in found:
        out = out.union(m)
    return r(out)


@query()
def l22_feature_importances(spark, d):
    x = rg.dataset(ad.prices(spark, d))
    _, model = rg.train_trees(x)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(rg.FEATURES, model.featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"))


@query(sql(PRICES, FEATS, """e as (select symbol, date, row_number() over (partition by symbol order by date desc) as left_over, count(r) over (partition by symbol order by date) as n, vol_forward from (select symbol, date, ret_1 as r, vol_forward from feats) where date <= date '1998-06-30')
select 'features' as probe, 0::bigint as n_changed union all select 'label, its past changed', 0 union all select 'label, its future taken away', count(*) from e where left_over <= 21 and vol_forward is not null"""))
def l23_leakage_probe(spark, d):
    """No feature changes when the future is taken away, and no label when the past is changed; as a control, the labels of each symbol's last 21 days do when their future is taken away."""
    p, cut = ad.prices(spark, d), "1998-06-30"
    label = lambda x: rg.forward_vol(rg.features(x))
    count = lambda rows, name: rows.agg(F.count("*").alias("n_changed")).select(F.lit(name).alias("probe"), "n_changed")
    past = count(rg.changed_by_past(p, cut, label, ["vol_forward"]), "label, its past changed")
    return count(rg.leakage(p, cut), "features").union(past).union(count(rg.changed_without_future(p, cut, label, ["vol_forward"]), "label, its future taken away"))


@query(sql(PRICES, """select cast(sum(cast(('0x' || substr(md5(concat_ws('|', symbol, strftime(date, '%Y-%m-%d'), cast(cast(round(close, 9) as decimal(20,9)) as varchar), cast(volume as varchar))), 1, 12)) as hugeint)) as varchar) as version,
  count(*) as n_rows, count(distinct symbol) as n_symbols, min(date) as first, max(date) as last from prices"""))
def l24_dataset_version(spark, d):
    return rg.dataset_version(ad.prices(spark, d))


RUN_METRICS = "metrics as (select c_mktsegment as model, c_nationkey as version, avg(c_acctbal) / 10000 - 0.4 as delta_f1 from customer group by 1, 2)"


def _run_metrics(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("version")).agg((F.avg("c_acctbal") / 10000 - 0.4).alias("delta_f1"))


@query(sql(RUN_METRICS, """select model, version, delta_f1 >= 0.05 as promoted, case when delta_f1 >= 0.05 then 'promoted: F1 beats the baseline by ' || printf('%.4f', delta_f1) || ', at least 0.0500' else 'rejected: F1 beats the baseline by only ' || printf('%.4f', delta_f1) || ', under 0.0500; the version in production stays' end as reason from metrics"""))
def l25_promotion_gate(spark, d):
    return rg.promotion(_run_metrics(spark, d))


@query("""with kv as (select 'wf_fold' || (s_nationkey % 5) || '_' || case s_suppkey % 2 when 0 then 'f1' else 'auc' end as k, max(s_acctbal) as v from supplier group by 1)
select cast(regexp_extract(k, 'fold([0-9]+)_', 1) as integer) as fold, max(v) filter (k like '%_f1') as f1, max(v) filter (k like '%_auc') as auc from kv group by 1""")
def l26_fold_metrics(spark, d):
    s = table(spark, d, "supplier")
    k = F.concat(F.lit("wf_fold"), (F.col("s_nationkey") % 5).cast("string"), F.lit("_"), F.when(F.col("s_suppkey") % 2 == 0, "f1").otherwise("auc"))
    kv = s.groupBy(k.alias("k")).agg(F.max("s_acctbal").alias("v"))
    parts = kv.select(F.regexp_extract("k", r"fold(\d+)_", 1).cast("int").alias("fold"), F.regexp_extract("k", r"fold\d+_(\w+)", 1).alias("name"), "v")
    return parts.groupBy("fold").pivot("name", ["f1", "auc"]).agg(F.max("v"))


@query(sql(RUN_METRICS, "select model, coalesce(max(version) filter (delta_f1 >= 0.05), max(version)) as version from metrics group by 1"))
def l27_model_status(spark, d):
    ok = F.when(F.col("promoted"), F.col("version"))
    return rg.promotion(_run_metrics(spark, d)).groupBy("model").agg(F.coalesce(F.max(ok), F.max("version")).alias("version"))


@query(sql(RAW, """arrived as materialized (
  select portfolio || ' ' || symbol as position, row_idx, kind, qty, price, case when row_idx % 7 = 0 then 3 when date < date '1995-01-01' then 0 when date < date '1998-01-01' then 1 else 2 end as arrival from raw),
seq as materialized (select *, row_number() over (partition by position order by arrival, row_idx) as rn from arrived),
st as (
  select position, rn, arrival, 0::double as q, 0::double as c, 0::bigint as last, 0::bigint as base, '' as outcome from (select position, 0 as rn, -1 as arrival from seq group by 1)
  union all
  select n.position, n.rn, n.arrival,
    case when n.row_idx < n.base or (n.kind = 'SELL' and n.qty > n.q + 1e-9) then n.q when n.kind = 'BUY' then n.q + n.qty else n.q - n.qty end,
    case when n.row_idx < n.base or (n.kind = 'SELL' and n.qty > n.q + 1e-9) then n.c when n.kind = 'BUY' then n.c + n.qty * n.price when n.q - n.qty <= 1e-9 then 0 else n.c * (1 - n.qty / n.q) end,
    case when n.row_idx < n.base or (n.kind = 'SELL' and n.qty > n.q + 1e-9) then n.last else n.row_idx end, n.base,
    case when n.row_idx < n.base then 'late' when n.kind = 'SELL' and n.qty > n.q + 1e-9 then 'oversold' else 'applied' end
  from (select q.*, s.q, s.c, s.last, case when q.arrival <> s.arrival then s.last else s.base end as base from st s join seq q on q.position = s.position and q.rn = s.rn + 1) n)
select position, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome = 'oversold') as oversold, count(*) filter (outcome = 'late') as late, round(last(q order by rn), 2) as qty, round(last(c order by rn), 1) as cost from st group by 1"""))
def st1_stream_positions(spark, d):
    """All trades in four arrivals, one for each trigger: three spans of years, then every seventh trade, mostly late."""
    path = f"{shared_dir(spark)}/tallyfold/stream-{uuid4().hex}"
    t = ad.raw_trades(spark, d)
    at = F.timestamp_micros(F.unix_micros(F.col("date").cast("timestamp")) + F.col("row_idx"))
    arrival = F.when(F.col("row_idx") % 7 == 0, 3).when(F.col("date") < "1995-01-01", 0).when(F.col("date") < "1998-01-01", 1).otherwise(2)
    rows = staged(t.select(F.concat_ws(" ", "portfolio", "symbol").alias("position"), F.col("row_idx").cast("long").alias("event_id"), at.alias("ts"), "kind", "qty", "price", arrival.alias("arrival")), "events")
    for k in range(4):  # each arrival is a run of its own, as new files come in
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{path}/in")
        run(source, path).awaitTermination()
    n = outcomes(spark, path).groupBy("position").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "oversold", "late")])
    s = states(spark, path).select("position", F.round("qty", 2).alias("qty"), F.round("cost", 1).alias("cost"))
    return n.join(s, "position")
