"""Hand-computed cases of the operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import stats as st
from tallyfold.operators import allocation as al
from tallyfold.operators import expectations as ex
from tallyfold.operators import forecast as fc
from tallyfold.operators import holdings as ho
from tallyfold.operators import performance as pf
from tallyfold.operators import regime as rg
from tallyfold.operators import risk as rk
from tallyfold.operators import scan as sc
from tallyfold.operators import temporal as tp
from tallyfold.operators import validation as va
from tallyfold.sources import marts, stores

D = dt.date
LEDGER = "portfolio string, symbol string, date date, kind string, qty double, price double, fees double, tax double, row_idx long"


def ledger(spark, rows):
    return spark.createDataFrame([("p", s, D(2024, 1, day), k, float(q), float(x), 0.0, 0.0, i) for i, (s, day, k, q, x) in enumerate(rows)], LEDGER)


def values(spark, xs, name="nav"):
    return spark.createDataFrame([("p", D(2024, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(xs)], f"portfolio string, date date, {name} double")


def test_oversell_is_rejected_and_changes_nothing(spark):
    t = ledger(spark, [("A", 1, "BUY", 4, 1), ("A", 2, "BUY", 1, 1), ("A", 3, "SELL", 50, 1), ("A", 4, "SELL", 5, 1), ("B", 1, "SELL", 1, 1)])
    assert [r.row_idx for r in ho.mark_oversold(t).where("rejected").orderBy("row_idx").collect()] == [2, 4]


def test_order_of_input_does_not_matter(spark):
    t = ledger(spark, [("A", 5, "SELL", 3, 1), ("A", 1, "BUY", 4, 1)])
    assert ho.mark_oversold(t).where("rejected").count() == 0


def test_weighted_cost_with_reentry(spark):
    t = ledger(spark, [("A", 1, "BUY", 10, 10), ("A", 2, "SELL", 4, 12), ("A", 3, "SELL", 6, 9), ("A", 4, "BUY", 5, 20), ("A", 5, "SELL", 1, 30)])
    got = [(r.qty, round(r.cost, 9)) for r in ho.positions(ho.moves(t)).orderBy("date").collect()]
    assert got == [(10, 100), (6, 60), (0, 0), (5, 100), (4, 80)]


def test_random_ledgers_match_a_walk(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("AB"), rnd.randint(1, 28), rnd.choice(["BUY", "SELL"]), rnd.randint(1, 9), rnd.randint(1, 50)) for _ in range(300)]
    good = ho.accepted(ledger(spark, rows))
    got = {(r.symbol, r.date.day): (r.qty, r.cost) for r in ho.positions(ho.moves(good)).collect()}
    state, want, gain = {}, {}, 0.0
    for r in sorted(good.collect(), key=lambda r: (r.date, r.row_idx)):
        q, c = state.get(r.symbol, (0.0, 0.0))
        assert r.kind == "BUY" or r.qty <= q + 1e-9
        state[r.symbol] = (q + r.qty, c + r.qty * r.price) if r.kind == "BUY" else (q - r.qty, c * (1 - r.qty / q))
        gain += 0 if r.kind == "BUY" else r.qty * r.price - c * r.qty / q
        want[(r.symbol, r.date.day)] = state[r.symbol]
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert ho.realized(good).first().realized_pnl == pytest.approx(gain)


def test_asof_join_backward_forward_and_tolerance(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 1)), ("b", D(2024, 1, 5))], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 4), 2.0)], "k string, t date, v double")
    back = {(r.k, r.d.day): r.v for r in tp.asof_join(left, right, ["k"], "d", "t", ["v"]).collect()}
    assert back == {("a", 5): 2.0, ("a", 1): None, ("b", 5): None}
    ahead = {(r.k, r.d.day): r.v for r in tp.asof_join(left, right, ["k"], "d", "t", ["v"], direction="forward").collect()}
    assert ahead == {("a", 5): None, ("a", 1): 1.0, ("b", 5): None}
    odd_left = left.union(spark.createDataFrame([(None, D(2024, 1, 5)), ("a", None)], "k string, d date"))
    odd_right = right.union(spark.createDataFrame([(None, D(2024, 1, 1), 7.0), ("b", None, 8.0)], "k string, t date, v double"))
    for direction in ("backward", "forward"):
        plain = sorted((r.k, r.d, r.v or 0) for r in tp.asof_join(left, right, ["k"], "d", "t", ["v"], direction=direction).collect())
        rows = tp.asof_join(odd_left, odd_right, ["k"], "d", "t", ["v"], direction=direction).collect()
        assert sorted((r.k, r.d, r.v or 0) for r in rows if r.k and r.d) == plain
        assert [r.v for r in rows if not (r.k and r.d)] == [None, None]
    near = {(r.k, r.d.day): r.v for r in tp.asof_join(left, right, ["k"], "d", "t", ["v"], tolerance_days=0).collect()}
    assert set(near.values()) == {None}


def test_carried_days_equal_an_asof_join_on_every_day(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 5), 2.0), ("b", D(2024, 1, 6), 3.0), ("c", D(2024, 2, 1), 4.0), ("d", None, 5.0)], "k string, d date, v double")
    until = F.lit("2024-01-07").cast("date")
    got = {(r.k, r.d.day): r.v for r in tp.carry(rows, ["k"], "d", until, ["v"]).collect()}
    assert got == {("a", 2): 1, ("a", 3): 1, ("a", 4): 1, ("a", 5): 2, ("a", 6): 2, ("a", 7): 2, ("b", 6): 3, ("b", 7): 3}


def test_versions_never_overlap(spark):
    cols = "ticker string, sector string, industry string, effective_from date, effective_to date, is_current boolean"
    old = spark.createDataFrame([("A", "x", None, D(2020, 1, 1), D(9999, 12, 31), True), ("B", "x", None, D(2020, 1, 1), D(9999, 12, 31), True)], cols)
    new = spark.createDataFrame([("A", "y", None, D(2021, 1, 1)), ("B", "x", None, D(2019, 1, 1)), ("C", "z", None, D(2021, 5, 5))], "ticker string, sector string, industry string, as_of date")
    got = {(r.ticker, r.sector): (r.effective_from, r.effective_to, r.is_current) for r in tp.scd2_upsert(old, new).collect()}
    assert got[("A", "x")] == (D(2020, 1, 1), D(2020, 12, 31), False)
    assert got[("A", "y")][0] == D(2021, 1, 1)
    assert got[("B", "x")][0] == D(2019, 1, 1)
    assert len(got) == 4


def test_reasons(spark):
    rows = [("2024-01-01", "A.NS", "BUY", "1", "1"), ("01/02/2024", "A.NS", "BUY", "1", "1"), ("2099-01-01", "A.NS", "BUY", "1", "1"), ("2024-01-01", "A", "BUY", "1", "1"), ("2024-01-01", "A.NS", "PURCHASE", "1", "1"), ("2024-01-01", "A.NS", "SELL", "-5", "1"), ("2024-01-01", "A.NS", " sell ", "1", "nan"), ("2024-01-01", None, "DEPOSIT", "", "5"), (None, "A.NS", "BUY", "1", "1")]
    got = [r.reason for r in va.validate(spark.createDataFrame(rows, "date string, ticker string, transaction_type string, quantity string, price string"), "2025-01-01").collect()]
    assert got == [None, "ambiguous date", "future date", "malformed ticker", "unknown transaction type", "invalid quantity", "invalid price", None, "invalid date"]


def test_inferred_currencies_count_as_imputed(spark):
    rows = [("u", 1, "2024-01-01", "A.NS", "BUY", "1", "2", "", "1", " ", None), ("u", 2, "2024-01-01", "B.NS", "BUY", "1", "2", "1", "1", "USD", None)]
    valid = spark.createDataFrame(rows, "k string, rid int, date string, ticker string, transaction_type string, quantity string, price string, fees string, tax string, currency string, reason string")
    rates = spark.createDataFrame(list(va.RATES.items()), "currency string, rate double")
    none = spark.createDataFrame([], "alias string, ticker string")
    got = {r.rid: (r.imputed, r.currency, r.currency_original) for r in va.clean(valid, none, rates, ["k"]).collect()}
    assert got == {1: (2, "INR", " "), 2: (0, "USD", "USD")}


def test_split_adjustment(spark):
    t = ledger(spark, [("A", 2, "BUY", 5, 177.85), ("A", 20, "SELL", 50, 18)])
    s = spark.createDataFrame([("A", D(2024, 1, 10), 10.0), ("A", D(2024, 1, 10), 10.0), ("A", D(2024, 1, 1), 2.0)], "symbol string, split_date date, ratio double")
    got = {r.kind: (r.qty, round(r.price, 6)) for r in va.split_adjust(t, s, ["portfolio", "symbol", "row_idx"]).collect()}
    assert got == {"BUY": (50.0, 17.785), "SELL": (50.0, 18.0)}


def test_returns(spark):
    v = values(spark, [100, 110, 121])
    assert pf.time_weighted(ho.nav_returns(v), ["portfolio"]).first().twr == pytest.approx(0.21)
    flow = spark.createDataFrame([("p", D(2024, 1, 2), 100.0)], "portfolio string, date date, flow double")
    x = pf.flow_returns(values(spark, [100, 200, 220], "mv"), flow, ["portfolio"])
    assert pf.time_weighted(x, ["portfolio"]).first().twr == pytest.approx(0.10)
    cf = spark.createDataFrame([("p", D(2023, 1, 1), -1000.0), ("p", D(2024, 1, 1), 1100.0), ("q", D(2024, 1, 1), 5.0)], "portfolio string, date date, cf double")
    got = {r.portfolio: r.xirr for r in pf.xirr(cf).collect()}
    assert got["p"] == pytest.approx(0.10, abs=1e-6) and got["q"] is None


def test_drawdown_episode(spark):
    got = rk.max_drawdown(values(spark, [100, 120, 90, 110, 130]), ["portfolio"], "nav").first()
    assert (got.max_drawdown, got.peak_date.day, got.trough.day, got.recovery.day, got.days) == (-0.25, 2, 3, 5, 3)


def test_risk_figures(spark):
    x = values(spark, [-0.05, -0.03, -0.01, 0.02, 0.04], "r")
    assert rk.historical_var(x, ["portfolio"], 0.75).first().var_hist == pytest.approx(0.03)
    assert rk.conditional_var(x, ["portfolio"], 0.75).first().cvar == pytest.approx(0.04)
    up = values(spark, [0.01, 0.02, 0.01], "r")
    assert rk.summary(up, ["portfolio"]).first().sortino is None


def test_concentration(spark):
    w = spark.createDataFrame([("p", n, x) for n, x in zip("abcd", (0.5, 0.3, 0.15, 0.05), strict=True)], "portfolio string, name string, weight double")
    got = al.concentration(w, 2).first()
    assert got.largest == 0.5 and got.top_n == pytest.approx(0.8) and got.hhi == pytest.approx(0.365)


def test_features_and_labels(spark):
    p = spark.createDataFrame([("s", D(2024, 1, 1) + dt.timedelta(i), 100 * 1.1**i, 10) for i in range(80)], "symbol string, date date, close double, volume long")
    f = rg.features(p).orderBy("date").collect()
    assert f[0].ret_1 is None and f[5].ret_5 == pytest.approx(1.1**5 - 1)
    assert f[9].vol_10 is None and f[10].vol_10 == pytest.approx(0, abs=1e-9)
    assert f[30].volume_z_21 is None and f[60].drawdown_60 == 0
    assert rg.leakage(p, "2024-02-20").count() == 0
    assert rg.forward_vol(rg.features(p)).where("vol_forward is not null").count() == 80 - 21


def test_binary_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.8), (0, 0, 0.1)], "label int, predicted int, score double")
    got = rg.binary_metrics(rows, [], score="score").first()
    assert (got.precision, got.recall, got.f1) == (0.5, 0.5, 0.5) and got.roc_auc == pytest.approx(0.875)


def test_split_and_fold_edges(spark):
    def days(n):
        return spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(i),) for i in range(n)], "date date")

    for n in (7, 10, 13, 20, 101):
        got = [r.split for r in rg.splits(days(n)).orderBy("date").collect()]
        a, b = int(n * 0.7), int(n * 0.85)
        assert got == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)
        edges = [int(n * k / 6) for k in range(1, 7)]
        folds = {(r.fold, r.date): r.part for r in rg.folds(days(n)).collect()}
        for k in range(1, 6):
            want = {D(2024, 1, 1) + dt.timedelta(i): "train" if i < edges[k - 1] else "test" for i in range(edges[k])}
            assert {x: p for (f, x), p in folds.items() if f == k} == want


def test_promotion_and_comparison_with_the_baseline(spark):
    m = spark.createDataFrame([("m", 1, 0.05), ("m", 2, 0.0499), ("m", 3, None)], "model string, version int, delta_f1 double")
    got = {r.version: (r.promoted, r.reason) for r in rg.promotion(m).collect()}
    assert got[1] == (True, "promoted: F1 beats the baseline by 0.0500, at least 0.0500") and not got[2][0] and not got[3][0]
    a = spark.createDataFrame([("x", 0.6, 0.5), ("y", 0.6, 0.3)], "k string, f1 double, pr_auc double")
    b = spark.createDataFrame([("x", 0.5, 0.4), ("y", 0.5, 0.4)], "k string, f1 double, pr_auc double")
    assert {r.k: r.better for r in rg.against_baseline(a, b, ["k"]).collect()} == {"x": True, "y": False}


def test_reports(spark):
    held = spark.createDataFrame([("p", "A", "x", 700.0), ("p", "B", "y", 300.0)], "portfolio string, symbol string, sector string, mv double")
    navs = spark.createDataFrame([("p", 1000.0, 250.0)], "portfolio string, mv double, cash double")
    got = {(r.section, r.name): round(r.value, 9) for r in al.report(held, navs, ["symbol", "sector"]).collect()}
    assert got == {("symbol", "A"): 0.7, ("symbol", "B"): 0.3, ("sector", "x"): 0.7, ("sector", "y"): 0.3, ("cash", "holdings_pct"): 0.8, ("cash", "cash_pct"): 0.2, ("concentration", "largest"): 0.7, ("concentration", "top_n"): 1.0, ("concentration", "hhi"): 0.58}
    v = values(spark, [100, 120, 90, 110, 130], "value")
    bench = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(i), x) for i, x in enumerate((0.0, 0.1, -0.2, 0.15, 0.2))], "date date, b double")
    one = rk.report(v, bench, ["portfolio"]).first()
    assert (one.max_drawdown, one.days, one.window_end.day) == (-0.25, 3, 5) and one.beta > 0 and one.cvar == pytest.approx(0.25)
    assert rk.report(v, bench, ["portfolio"], start="2024-01-04").count() == 0
    with pytest.raises(ValueError):
        rk.in_window(v, ["portfolio"], "2024-02-01", "2024-02-01")
    total = spark.createDataFrame([("p", 0.5)], "portfolio string, total double")
    r = v.withColumn("r", F.lit(0.01))
    c = al.compare(r, bench, ["portfolio"], headline=total).first()
    assert c.cum_portfolio == 0.5 and c.cum_excess == pytest.approx(0.5 - c.cum_benchmark)


def test_attribution_reconciles(spark):
    day = D(2024, 1, 1)
    marked = spark.createDataFrame([("p", s, day + dt.timedelta(k), mv) for k, row in enumerate(((60.0, 40.0), (66.0, 38.0))) for s, mv in zip("AB", row, strict=True)], "portfolio string, symbol string, date date, mv double")
    closes = spark.createDataFrame([(s, day + dt.timedelta(k), c) for k, row in enumerate(((6.0, 4.0), (6.6, 3.8))) for s, c in zip("AB", row, strict=True)], "symbol string, date date, close double")
    windows = spark.createDataFrame([("p", day, day + dt.timedelta(1))], "portfolio string, start date, `end` date")
    got = {r.symbol: r for r in al.attribution(marked, closes, windows, spark.createDataFrame([("A", "x"), ("B", "x")], "symbol string, sector string")).collect()}
    assert got["A"].contribution == pytest.approx(0.06) and got["B"].contribution == pytest.approx(-0.02)
    assert got["A"].total == pytest.approx(0.04) == pytest.approx(got["B"].actual) and got["A"].sector_contribution == pytest.approx(0.04)


def test_forecast_and_backtest(spark):
    flat = spark.createDataFrame([("s", D(2024, 1, 1) + dt.timedelta(i), 1000.0) for i in range(300)], "k string, date date, value double")
    got = fc.drift_forecast(flat, ["k"], 5).orderBy(F.desc("h")).first()
    assert got.point == 1000 and got.high_95 - got.low_95 < 50
    assert fc.backtest_summary(fc.backtest(flat, ["k"], 30), ["k"]).first().mae == 0
    assert fc.backtest(flat, ["k"], 199).count() == 0 and fc.backtest(flat, ["k"], 198).count() > 0  # more than 100 + 199 + 1 rows are needed


def test_path_drawdowns(spark):
    p = spark.createDataFrame([("k", 1, 1, 100.0), ("k", 1, 2, 75.0), ("k", 2, 1, 100.0), ("k", 2, 2, 100.0)], "k string, path_id int, step int, value double")
    assert fc.path_drawdowns(p, ["k"]).first().mean_dd == -0.125


def test_expectations(spark):
    t = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, v string")
    got = {r.expectation: r.n_violations for r in ex.suite({"u": ex.unique(t, "k"), "n": ex.not_null(t, "v"), "a": ex.accepted(t, "v", ["a"]), "r": ex.in_range(t, "k", 1, 1)}).collect()}
    assert got == {"u": 1, "n": 1, "a": 1, "r": 1}


def test_ledger_files(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("date,ticker,transaction_type,quantity,price,fees,tax,currency\n2024-01-01,A.NS,BUY,1,2,,,\n")
    row = stores.read_ledger_csv(spark, str(f), "p").first()
    assert row.fees == "" and row.ticker == "A.NS"
    f.write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="missing columns: date"):
        stores.read_ledger_csv(spark, str(f), "p")
    out = str(tmp_path / "ledger")
    rows = lambda *x: spark.createDataFrame(list(x), "portfolio string, v int")
    stores.replace_history(rows(("a", 1), ("b", 2)), out)
    stores.replace_history(rows(("a", 3)), out)
    stores.replace_history(rows(), out)
    assert sorted((r.portfolio, r.v) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 2)]


def test_stream_equals_batch(spark, tmp_path):
    from tallyfold.streaming.advance import advance, outcomes, run, states

    rnd = random.Random(3)
    rows = [(rnd.choice("AB"), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), rnd.choice(["BUY", "SELL"]), float(rnd.randint(1, 9)), float(rnd.randint(1, 20))) for i in range(120)]
    schema = "position string, event_id long, ts timestamp, kind string, qty double, price double"
    src, path = str(tmp_path / "in"), str(tmp_path / "run")
    mixed = rnd.sample(rows[:60], 60)
    for part in (mixed[:20] + mixed[20:], rows[60:], [("A", 999, dt.datetime(2023, 1, 1), "BUY", 1.0, 1.0), ("C", 1000, dt.datetime(2023, 1, 1), "SELL", 1.0, 1.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        run(spark.readStream.schema(schema).parquet(src), path).awaitTermination()
    got = outcomes(spark, path).collect()
    assert len(got) == 122 and [(r.position, r.event_id) for r in got if r.outcome == "late"] == [("A", 999)]
    assert spark.read.parquet(path + "/out").where("outcome = 'oversold'").count() == sum(r.outcome == "oversold" for r in got)
    state, over = {}, 1  # C sells what it does not have
    for p, _, _, kind, q, x in rows:
        have, cost = state.get(p, (0.0, 0.0))
        if kind == "SELL" and q > have:
            over += 1
        else:
            state[p] = (have + q, cost + q * x) if kind == "BUY" else (have - q, cost * (1 - q / have))
    assert sum(r.outcome == "oversold" for r in got) == over
    held = {r.position: r for r in states(spark, path).collect()}
    for p, (have, cost) in state.items():
        last = max((r for r in got if r.position == p and r.outcome == "applied"), key=lambda r: r.event_id)
        assert last.qty == held[p].qty == pytest.approx(have) and last.cost == held[p].cost == pytest.approx(cost, abs=1e-6)
    # a batch that is run again from the states before it gives the same states
    before, batch = states(spark, path, 0), spark.createDataFrame(rows[60:], schema)
    again = {r.position: (r.qty, r.cost, r.last) for r in advance(before, batch)[1].collect()}
    assert again == {r.position: (r.qty, r.cost, r.last) for r in states(spark, path, 1).collect()}


def test_weighted_cost_over_thousands_of_partial_sells(spark):
    day = lambda k: D(2000, 1, 1) + dt.timedelta(k)
    rows = [("p", "half", day(0), 10.0, 1000.0, 0.0)] + [("p", "half", day(k), 5.0, 500.0, 5.0) for k in range(1, 2500)]
    rnd, want, q, c = random.Random(3), [], 0.0, 0.0
    for k in range(6000):
        sell = q * rnd.choice([0.0, 0.25, 0.875, 0.984375]) if rnd.random() < 0.85 else 0.0
        if rnd.random() < 0.01:
            sell = q
        buy = float(rnd.choice([1, 50])) if q - sell < 1e-4 or rnd.random() < 0.4 else 0.0
        paid = buy * rnd.uniform(1, 200)
        rows.append(("p", "random", day(k), buy, paid, sell))
        c = c * (0 if q - sell <= ho.EPS else 1 - sell / q) + paid
        q += buy - sell
        want.append((q, c))
    df = spark.createDataFrame(rows, "portfolio string, symbol string, date date, buy_qty double, buy_cost double, sell_qty double")
    got = ho.positions(df).orderBy("symbol", "date").collect()
    assert all(r.cost == pytest.approx(1000) for r in got if r.symbol == "half")
    walked = [(r.qty, r.cost) for r in got if r.symbol == "random"]
    assert len(walked) == 6000
    assert all(a[1] == pytest.approx(b[1], rel=1e-5, abs=1e-4) and a[0] == pytest.approx(b[0], abs=1e-6) for a, b in zip(walked, want, strict=True))


def test_prefix_equals_a_window_and_percentiles_numpy(spark):
    import numpy as np
    from pyspark.sql import Window

    rnd = random.Random(8)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), i, rnd.choice([None, rnd.random(), 0.5, 0.0])) for i in range(3000)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum("v").over(w)).withColumn("l", F.last("v", ignorenulls=True).over(w))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a key in many ranges, as in large tables
    try:
        got = sc.prefix(df, ["k"], [F.col("i")], {"s": "v"}, {"l": "v"})
        key = lambda r: (str(r.k), r.i)
        for x, y in zip(sorted(got.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
            assert (x.k, x.i, x.v, x.l) == (y.k, y.i, y.v, y.l) and x.s == (y.s if y.s is None else pytest.approx(y.s))
        by = {r.k: r for r in sc.percentiles(df, ["k"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
        assert set(by) == {"hot", "a", None}
        for k, r in by.items():
            xs = [v for kk, _, v in rows if kk == k and v is not None]
            assert [r.low, r.mid, r.top] == pytest.approx(list(np.percentile(xs, [5, 50, 100])))
        whole = sc.percentiles(df, [], "v", {"q": 0.3}).first().q
        assert whole == pytest.approx(np.percentile([v for *_, v in rows if v is not None], 30))
        assert sc.percentiles(df.where("false"), ["k"], "v", {"q": 0.3}).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_asof_join_in_ranges_equals_the_window(spark):
    rnd = random.Random(9)
    left = spark.createDataFrame([(rnd.choice(["hot"] * 9 + ["b", None]), D(2020, 1, 1) + dt.timedelta(rnd.randint(0, 900)), i) for i in range(1500)], "k string, d date, i int")
    right = spark.createDataFrame([(rnd.choice(["hot", "hot", "b"]), D(2020, 1, 1) + dt.timedelta(rnd.randint(0, 900)), float(i)) for i in range(60)], "k string, t date, x double")
    for options in ({}, {"direction": "forward"}, {"tolerance_days": 5}):
        a = tp.asof_join(left, right, ["k"], "d", "t", ["x"], **options)
        b = tp.asof_join(left, right, ["k"], "d", "t", ["x"], blocked=True, **options)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_correlations_by_blocks_of_assets(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(rk, "BLOCK_ASSETS", 3)
    monkeypatch.setattr(rk, "SPANS", 5)
    gen = np.random.default_rng(5)
    wide = pd.DataFrame(gen.normal(size=(90, 11)) + 100, columns=[f"s{i}" for i in range(11)])
    wide["s1"] = wide["s0"] * 2 + 1
    wide["s2"] = 7.0  # no variance
    wide = wide.mask(gen.random(wide.shape) < 0.2)
    long = [(s, D(2024, 1, 1) + dt.timedelta(int(i)), float(wide.at[i, s])) for s in wide for i in wide.index if not np.isnan(wide.at[i, s])]
    got = {(r.a, r.b): (r.corr, r.n) for r in rk.correlations(spark.createDataFrame(long, "symbol string, date date, r double"), [], "symbol").collect()}
    want = wide.corr()
    assert len(got) == 66
    for (a, b), (corr, n) in got.items():
        assert a <= b and n == (wide[a].notna() & wide[b].notna()).sum()
        assert corr is None or np.isnan(corr) if np.isnan(want.at[a, b]) else corr == pytest.approx(want.at[a, b], abs=1e-9)


def test_marts_are_read_and_refreshed_by_folder(spark, tmp_path):
    path = str(tmp_path / "mart")
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-06-30')) as date").withColumn("portfolio", F.explode(F.array(*[F.lit(p) for p in "ABCDEFG"]))).withColumn("v", F.lit(1.0))
    marts.write(days, path, "portfolio", "date")
    schema = marts.placed(days, "portfolio", "date").schema
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    one = marts.read(spark, path, "portfolio", "date", schema, "C", "2024-03-10", "2024-03-20")
    assert one.count() == 11 and files(one) == 1
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    day = marts.read(spark, path, "portfolio", "date", schema, start="2024-05-05", end="2024-05-05")
    assert day.count() == 7 and files(day) <= marts.BUCKETS
    marts.write(days.where("date >= '2024-06-01'").withColumn("v", F.lit(2.0)), path, "portfolio", "date")
    assert [tuple(r) for r in marts.read(spark, path, "portfolio", "date", schema).groupBy("v").count().orderBy("v").collect()] == [(1.0, 152 * 7), (2.0, 30 * 7)]


def test_merge_rewrites_touched_folders_only(spark, tmp_path):
    import os

    path = str(tmp_path / "prices")
    row = "symbol string, date date, close double, v int"
    old = spark.createDataFrame([(s, D(2024, m, d), 1.0, 1) for s in "AB" for m in (1, 2, 3) for d in (1, 2)], row)
    marts.write(old, path, "symbol", "date")
    stamp = lambda: {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = stamp()
    batch = spark.createDataFrame([("A", D(2024, 2, 1), 5.0, 2), ("A", D(2024, 2, 2), 9.0, 0), ("A", D(2024, 2, 3), 6.0, 2), ("A", D(2024, 2, 3), 4.0, 1), ("A", D(2024, 1, 1), 1.0, 1)], row)
    key = ["symbol", "date"]
    assert marts.merge(batch, path, "symbol", "date", key, "v") == 1
    after = stamp()
    assert {f.split("month=")[1][:7] for f, _ in set(before.items()) ^ set(after.items())} == {"2024-02"} and set(before) & set(after)
    rows = {(r.symbol, r.date.isoformat()): r.close for r in spark.read.parquet(path).collect()}
    assert rows[("A", "2024-02-01")] == 5.0 and rows[("A", "2024-02-02")] == 1.0 and rows[("A", "2024-02-03")] == 6.0 and len(rows) == 13
    assert marts.merge(batch, path, "symbol", "date", key, "v") == 0 and stamp() == after
    broken = spark.createDataFrame([("B", D(2024, 3, 1), 8.0, 2)], row).withColumn("close", F.expr("if(close > 7, raise_error('torn'), close)").cast("double"))
    with pytest.raises(Exception, match="torn"):
        marts.merge(broken, path, "symbol", "date", key, "v")
    assert stamp() == after


def test_cash_and_flows_of_dividends_deposits_withdrawals(spark):
    rows = [("p", "A", D(2024, 1, 1), "BUY", 2.0, 10.0, 1.0, 0.0, 1), ("p", "A", D(2024, 1, 2), "DIVIDEND", 0.0, 3.0, 0.0, 0.0, 2), ("p", "A", D(2024, 1, 2), "DEPOSIT", 0.0, 50.0, 0.0, 0.0, 3), ("p", "A", D(2024, 1, 3), "WITHDRAWAL", 0.0, 20.0, 0.0, 0.0, 4), ("p", "A", D(2024, 1, 3), "SELL", 1.0, 12.0, 0.5, 0.25, 5)]
    t = spark.createDataFrame(rows, LEDGER)
    deltas = {r.date.day: r.delta for r in ho.cash_delta(t).collect()}
    assert deltas == {1: 0.0, 2: 53.0, 3: pytest.approx(-20 + 11.25)}
    assert {r.date.day: r.balance for r in ho.running_cash(ho.cash_delta(t)).collect()}[3] == pytest.approx(44.25)
    flows = {r.date.day: r.cf for r in pf.investor_flows(t, spark.createDataFrame([("p", D(2024, 1, 5), 14.0)], "portfolio string, date date, mv double")).collect()}
    assert flows == {1: -21.0, 2: 3.0, 3: pytest.approx(11.25), 5: 14.0}


def test_quality_report_counts_split_adjustments(spark):
    valid = spark.createDataFrame([("p", None), ("p", "bad"), ("q", None)], "portfolio string, reason string")
    clean = spark.createDataFrame([("p", False, 1, False, False), ("q", True, 0, True, False)], "portfolio string, near_duplicate boolean, imputed int, anomaly boolean, unresolved boolean")
    notes = spark.createDataFrame([("p", "A", "2024-01-01 x2.0"), ("p", "A", "2024-01-01 x2.0"), ("p", "B", None)], "portfolio string, symbol string, note string")
    got = {r.portfolio: r for r in va.quality_report(valid, clean, ["portfolio"], notes).collect()}
    assert (got["p"].split_adjustments_applied, got["p"].notes) == (2, ["A: 2024-01-01 x2.0 (2 rows)"]) and (got["q"].split_adjustments_applied, got["q"].notes) == (0, [])


def test_labels_do_not_move_with_the_past(spark):
    rnd = random.Random(2)
    p = spark.createDataFrame([("A", D(2024, 1, 1) + dt.timedelta(i), 100 + rnd.random() * 9, 5) for i in range(200)], "symbol string, date date, close double, volume long")
    label = lambda x: rg.forward_vol(rg.features(x))
    assert rg.changed_by_past(p, "2024-04-01", label, ["vol_forward"]).count() == 0
    assert rg.changed_by_past(p, "2024-04-01", rg.features, ["vol_21"]).count() > 0


def test_trees_learn_planted_regimes(spark):
    """Calm stretches and a wild fifth alternate; the volatility of the last days tells the label of the next."""
    rnd, level, rows = random.Random(6), 0.0, []
    for i in range(1500):
        level = 0.95 * level + rnd.gauss(0, 0.05 if (i // 100) % 5 == 4 else 0.005)
        rows.append(("A", D(2020, 1, 1) + dt.timedelta(i), 100 * math.exp(level), 1000 + i % 7))
    x = rg.dataset(spark.createDataFrame(rows, "symbol string, date date, close double, volume long"))
    x = spark.createDataFrame(x.collect(), x.schema)
    made, model = rg.train_trees(x.where("date < '2022-11-01'"), max_iter=15)
    from pyspark.ml.functions import vector_to_array

    out = model.transform(made.transform(x.where("date >= '2022-11-01'"))).withColumn("predicted", F.col("prediction").cast("int")).withColumn("score", vector_to_array("probability")[1])
    m = rg.binary_metrics(out, [], score="score").first()
    assert m.roc_auc > 0.8 and m.f1 > 0.6
    weight = dict(zip(rg.FEATURES, model.featureImportances.toArray(), strict=True))
    assert sum(v for k, v in weight.items() if k.startswith("vol_")) > 0.5


def test_tree_queries_train_the_whole_model(spark, monkeypatch):
    from types import SimpleNamespace

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from tallyfold.operators import regime as rg
    from tallyfold.plans import adapter
    from tallyfold.plans.catalogue import QUERIES

    days = spark.range(500).select(F.lit("A").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (100 + 9 * F.rand(1) * F.sin(F.col("id") / 9)).alias("close"), (1000 + F.col("id") % 7).alias("volume"))
    days = spark.createDataFrame(days.collect(), days.schema)
    asked = []

    def train(rows, max_iter=200):
        asked.append(max_iter)
        constant = lambda x: x.withColumn("prediction", F.lit(1.0)).withColumn("probability", array_to_vector(F.array(F.lit(0.4), F.lit(0.6))))
        return SimpleNamespace(transform=lambda x: x), SimpleNamespace(transform=constant, featureImportances=SimpleNamespace(toArray=lambda: [0.0] * len(rg.FEATURES)))

    monkeypatch.setattr(rg, "train_trees", train)
    monkeypatch.setattr(adapter, "prices", lambda spark, d: days)
    assert {r.split for r in QUERIES["l17_boosted_trees"](spark, "").collect()} == {"val", "test"}
    assert sorted(r.fold for r in QUERIES["l20_walk_forward"](spark, "").collect()) == [1, 2, 3, 4, 5]
    assert QUERIES["l22_feature_importances"](spark, "").count() == len(rg.FEATURES)
    assert asked == [200] * 7


def test_cleaning_deals_rows_once(spark):
    rows = [("k", 1, "2024-01-01", "A.NS", "BUY", "1", "10", "", "1", " "), ("k", 2, "2024-01-01", "A.NS", "BUY", "1", "10", "0", "1", "USD"), ("k", 3, "2024-01-02", "A.NS", "SELL", "1", "12", "0", "x", "usd"), ("k", 4, "2024-01-02", "B.NS", "BUY", "2", "5", "0", "0", "XYZ"), ("k", 5, "2024-01-02", "A.NS", "BUY", "1", "12.5", "0", "0", "INR")]
    valid = spark.createDataFrame(rows, "k string, rid long, date string, ticker string, transaction_type string, quantity string, price string, fees string, tax string, currency string")
    rates = spark.createDataFrame([("INR", 1.0), ("USD", 80.0), ("USD", 80.0)], "currency string, rate double")
    out = va.clean(valid, spark.createDataFrame([("B.NS", "C.NS")], "alias string, ticker string"), rates, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k#") == 1
    got = {r.rid: (r.ticker, r.currency, r.price_base, r.imputed, r.unresolved, r.near_duplicate, r.anomaly) for r in out.collect()}
    assert got == {1: ("A.NS", "INR", 10.0, 2, False, False, False), 3: ("A.NS", "USD", 960.0, 1, False, True, True), 4: ("C.NS", "XYZ", None, 0, True, False, False), 5: ("A.NS", "INR", 12.5, 0, False, True, False)}


def test_split_adjustment_reads_the_ledger_once_and_deals_no_trades(spark):
    rows = [(None if day == 9 else "p", s, D(2024, 1, day), k, 1.0, 60.0, day) for s in "AB" for day, k in ((1, "BUY"), (4, "DIVIDEND"), (5, "BUY"), (9, "SELL"), (10, "BUY"), (20, "SELL"))]
    t = spark.createDataFrame(rows, "portfolio string, symbol string, date date, kind string, qty double, price double, row_idx long")
    s = spark.createDataFrame([("A", D(2024, 1, 10), 2.0), ("A", D(2024, 1, 5), 3.0), ("A", D(2024, 1, 10), 2.0), ("A", D(2024, 1, 10), 5.0)], "symbol string, split_date date, ratio double")
    out = va.split_adjust(t, s)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and text.count("Scan ExistingRDD") == 1
    got = {(r.symbol, r.date.day): (r.qty, r.price, r.note) for r in out.collect()}
    two = "2024-01-10 x2.0; 2024-01-10 x5.0"
    assert {d: v for (x, d), v in got.items() if x == "A"} == {1: (30.0, 2.0, f"2024-01-05 x3.0; {two}"), 4: (1.0, 60.0, None), 5: (10.0, 6.0, two), 9: (10.0, 6.0, two), 10: (1.0, 60.0, None), 20: (1.0, 60.0, None)}
    assert all(v == (1.0, 60.0, None) for (x, _), v in got.items() if x == "B") and len(got) == 12


def test_trades_are_dealt_once_by_position(spark):
    t = ledger(spark, [("A", 1, "BUY", 5, 10), ("A", 1, "SELL", 2, 12), ("A", 2, "SELL", 9, 12), ("A", 3, "BUY", 1, 16), ("A", 4, "SELL", 4, 9), ("B", 1, "SELL", 1, 5), ("B", 2, "BUY", 2, 5), ("B", 3, "SELL", 2, 7)])
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(portfolio#")
    marked = ho.mark_oversold(t)
    assert dealt(marked) == 2  # the rows before a position falls below zero, and those after
    assert sorted((r.symbol, r.date.day) for r in marked.where("rejected").collect()) == [("A", 2), ("B", 1)]
    good = t.where("not (symbol = 'A' and day(date) = 2) and not (symbol = 'B' and day(date) = 1)")
    got = ho.realized(good)
    assert dealt(got) == 2  # by position and by portfolio
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert row.realized_pnl == pytest.approx(2 * (12 - 10) + (4 * 9 - (3 * 10 + 16)) + 2 * (7 - 5)) and row.deployed == 50 + 16 + 10
