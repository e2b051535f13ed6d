"""Registered queries against their SQL on the smallest tables (a spread of them; all run in the driver's check)."""

import os
import re

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{t}')")
    return c


def rows(df):
    """Whole rows in a fixed order, keys first by their text; floats are compared apart."""
    cols = sorted(df.columns)
    plain = lambda v: "~" if v is None or v != v else int(v) if isinstance(v, (int, float)) and v == int(v) else str(v)[:10] if hasattr(v, "isoformat") else v
    out = [[plain(v) for v in r] for r in df[cols].itertuples(index=False)]
    return sorted(out, key=lambda r: [f"{v:.3f}" if isinstance(v, float) else str(v) for v in r])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["s6_performance_reader", "s7_replace_history", "s8_price_upsert", "s10_cascade_delete", "v1_v7_reasons", "v8_oversell", "c1_c9_clean", "c10_quality_report", "d3_scd2_upsert", "d10_asof_join", "m1_asset_performance", "m6_value_on_date", "l18_baseline_metrics", "a6_allocation_report", "a7_overview", "b4_headline", "t5_trades_in_window", "t6_attribution_report", "r10_correlations", "r13_risk_report", "g2_asset_calibration", "l13_split", "l14_folds", "l25_promotion_gate", "g6_path_drawdowns", "st1_stream_positions"])
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    a, b = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for x, y in zip(rows(a), rows(b), strict=True):
        assert x == [pytest.approx(v, rel=1e-6, abs=1e-5) if isinstance(v, (int, float)) else v for v in y]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_text_ledger_is_numbered_without_dealing_lines_by_portfolio(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tallyfold.plans import catalogue

    # Some orders come twice: for the same customer and for another one.
    c, o = duckdb.connect(), f"read_parquet('{DIR}/orders.parquet')"
    for t in ("lineitem", "customer", "part"):
        os.symlink(f"{DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    c.execute(f"copy (select * from {o} union all select * from {o} where o_orderkey % 10 = 0 union all select * replace (o_custkey + 1 as o_custkey) from {o} where o_orderkey % 10 = 1) to '{tmp_path}/orders.parquet' (format parquet)")
    c.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    got = catalogue.v1_v7_reasons(spark, str(tmp_path))
    want = c.execute(catalogue.ORACLES["v1_v7_reasons"]).fetchdf()
    assert len(want) > 6000 and rows(got.toPandas()) == rows(want)
    assert not re.search(r"windowspecdefinition\(c_mktsegment#\d+, l_orderkey", plan(got))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["a7_overview", "b4_headline"])
def test_reports_read_closes_and_totals_that_are_written_once(spark, name):
    from tallyfold.plans import catalogue

    assert "l_linenumber" not in plan(catalogue.QUERIES[name](spark, DIR))


def test_entry_imports_and_has_a_query_per_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
