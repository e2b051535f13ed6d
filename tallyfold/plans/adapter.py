"""The trade model over the given star-schema tables, as DataFrames and as the SQL that defines the same rows.

Portfolio: customer market segment. Symbol: part brand. A line item is a trade: returned lines sell, others
buy. Prices are made of the trades of a symbol's day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str, fine: bool = False) -> DataFrame:
    """Every line item with its portfolio and symbol; customers and parts are joined on their keys. `fine`: a portfolio for each segment and nation."""
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    name = F.concat("c_mktsegment", F.lit("/"), "c_nationkey") if fine else F.col("c_mktsegment")
    owner = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", name.alias("portfolio"))
    brand = p.select("p_partkey", F.col("p_brand").alias("symbol"), "p_type")
    return li.join(owner, li.l_orderkey == owner.o_orderkey).join(brand, li.l_partkey == brand.p_partkey)


def raw_trades(spark: SparkSession, d: str, fine: bool = False) -> DataFrame:
    """Trades numbered by position; what follows from a line's columns is made after lines are dealt by position."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines(spark, d, fine).select("portfolio", "symbol", F.col("l_shipdate").cast("date").alias("date"), *ORDER)
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("portfolio", "symbol").orderBy("date", *ORDER)))
    return rows.select("portfolio", "symbol", "date", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("kind"), F.col("l_quantity").alias("qty"), price.alias("price"), (F.col("l_discount") * price).alias("fees"), (F.col("l_tax") * price).alias("tax"), "row_idx")


def prices(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), price.alias("price"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("x")).alias("o"), "l_quantity")
    return rows.groupBy("symbol", "date").agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


RAW = f"""raw as materialized (
  select c_mktsegment as portfolio, p_brand as symbol, cast(l_shipdate as date) as date, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as kind,
    l_quantity as qty, l_extendedprice / l_quantity as price, l_discount * (l_extendedprice / l_quantity) as fees, l_tax * (l_extendedprice / l_quantity) as tax,
    row_number() over (partition by c_mktsegment, p_brand order by cast(l_shipdate as date), {", ".join(ORDER)}) as row_idx
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""

RAW_FINE = RAW.replace("c_mktsegment", "(c_mktsegment || '/' || c_nationkey)")

MONTHLY = """monthly as materialized (select symbol, last_day(date) as date, last(close order by date) as close from prices group by symbol, last_day(date))"""

# Oversold sells are found by walking each position trade by trade.
WALK = """walk as (
  select portfolio, symbol, row_idx, case when kind = 'BUY' then qty when qty > 1e-9 then 0.0 else -qty end as held, kind = 'SELL' and qty > 1e-9 as rejected from raw where row_idx = 1
  union all
  select r.portfolio, r.symbol, r.row_idx, case when r.kind = 'BUY' then w.held + r.qty when r.qty > w.held + 1e-9 then w.held else w.held - r.qty end, r.kind = 'SELL' and r.qty > w.held + 1e-9
  from walk w join raw r on r.portfolio = w.portfolio and r.symbol = w.symbol and r.row_idx = w.row_idx + 1),
ledger as materialized (select raw.* from raw join walk using (portfolio, symbol, row_idx) where not walk.rejected)"""

PRICES = """prices as materialized (
  select symbol, date, first(price order by o1, o2, o3, o4, price) as open, max(price) as high, min(price) as low, last(price order by o1, o2, o3, o4, price) as close, cast(sum(q) as bigint) as volume
  from (select p_brand as symbol, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as price, l_orderkey as o1, l_linenumber as o2, l_partkey as o3, l_suppkey as o4, l_quantity as q
        from lineitem join part on l_partkey = p_partkey) group by symbol, date)"""

MOVES = """moves as materialized (
  select portfolio, symbol, date, sum(case when kind = 'BUY' then qty else 0 end) as buy_qty, sum(case when kind = 'BUY' then price * qty + fees else 0 end) as buy_cost,
    sum(case when kind = 'SELL' then qty else 0 end) as sell_qty, row_number() over (partition by portfolio, symbol order by date) as rn
  from ledger group by portfolio, symbol, date)"""

# Weighted-average cost, day by day.
STATE = """state as (
  select portfolio, symbol, date, rn, buy_qty - sell_qty as qty, case when buy_qty > 0 then buy_cost * (1 - sell_qty / buy_qty) else 0 end as cost from moves where rn = 1
  union all
  select m.portfolio, m.symbol, m.date, m.rn, s.qty + m.buy_qty - m.sell_qty,
    s.cost * (case when s.qty - least(m.sell_qty, s.qty) <= 1e-9 then 0 else 1 - least(m.sell_qty, s.qty) / s.qty end)
      + case when m.buy_qty > 0 then m.buy_cost * (1 - (m.sell_qty - least(m.sell_qty, s.qty)) / m.buy_qty) else 0 end
  from state s join moves m on m.portfolio = s.portfolio and m.symbol = s.symbol and m.rn = s.rn + 1),
held as materialized (select * from state)"""

AS_OF = "as_of as (select max(date) as day from ledger)"

CUBE = """cube_days as (
  select h.portfolio, h.symbol, cast(unnest(generate_series(h.first, (select day from as_of), interval 1 day)) as date) as date
  from (select portfolio, symbol, min(date) as first from held group by portfolio, symbol) h),
cube as materialized (
  select c.portfolio, c.symbol, c.date, h.qty, h.cost from cube_days c asof join held h on c.portfolio = h.portfolio and c.symbol = h.symbol and c.date >= h.date),
marked as materialized (
  select c.*, p.close, c.qty * coalesce(p.close, 0) as mv from cube c asof left join prices p on c.symbol = p.symbol and c.date >= p.date)"""

NAV = """cash as (select portfolio, date, sum(case when kind = 'SELL' then price * qty - fees - tax else 0 end) as delta from ledger group by portfolio, date),
cash_run as (select portfolio, date, sum(delta) over (partition by portfolio order by date) as balance from cash),
mv_day as (select portfolio, date, sum(mv) as mv, sum(cost) as cost from marked group by portfolio, date),
nav as materialized (
  select m.portfolio, m.date, m.mv, m.cost, coalesce(c.balance, 0) as cash, m.mv + coalesce(c.balance, 0) as nav
  from mv_day m asof left join cash_run c on m.portfolio = c.portfolio and m.date >= c.date),
rets as materialized (
  select *, (nav - lag(nav) over w) / nullif(abs(lag(nav) over w), 0) as r from nav window w as (partition by portfolio order by date))"""

INDEX = """idx as (select cast(l_shipdate as date) as date, sum(l_extendedprice) / sum(l_quantity) as close from lineitem group by 1)"""


def sql(*parts: str) -> str:
    """`with` clause of the parts in order; the last part is the query, or ends with it."""
    return "with recursive " + ",\n".join(parts[:-1]) + ("\n" if parts[-1].lstrip().startswith("select") else ",\n") + parts[-1]


TO_LEDGER = (RAW, WALK)
TO_HELD = (*TO_LEDGER, MOVES, STATE)
TO_MARKED = (*TO_HELD, PRICES, AS_OF, CUBE)
TO_NAV = (*TO_MARKED, NAV)
