"""Registered queries against their SQL in DuckDB, and the contract of the entry module."""

import os

import duckdb
import pandas as pd
import pytest

from tickloom.plans import flagship, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
CHOSEN = ["time_bars", "volume_bars", "moving_averages", "oscillators", "volume_flow", "recursive_averages", "volume_profile", "trade_signs_and_spreads", "illiquidity", "pit_join", "back_adjust", "asof_join", "coverage", "metrics", "covariance", "cross_sectional_momentum", "zero_gamma", "max_pain", "fundamental_ratios", "scores", "screening", "transition_counts", "autocorrelation", "climaxes", "volatility", "survivorship", "hedge_ratio", "preliminary_support", "zigzag", "parabolic_sar", "supertrend", "kama", "layered_averages", "range_events", "shift_divergence", "harmony", "hull_ribbon", "ema_cross_atr", "model_features", "option_greeks", "vpin", "valuation_models", "dollar_bars", "learned_signals", "learned_fold_scores", "gex_defence", "confluence_signals", "financial_statements"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif str(df[c].dtype) in ("object", "bool", "str"):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    mine, theirs = plain(registry.QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(registry.SQL[name]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, atol=1e-6)


def test_hidden_states_of_every_user(spark):
    out = registry.QUERIES["discrete_hmm"](spark, DATA).toPandas()
    events = pd.read_parquet(f"{DATA}/events.parquet")
    assert out.set_index("user_id").n.to_dict() == events.groupby("user_id").size().to_dict() and (out.log_likelihood <= 0).all()


def test_all_pairs_of_the_panel(spark):
    want = {f"{a}-{b}" for a in range(5) for b in range(a + 1, 5)}
    for name in ("cointegration", "pairs_strategy"):
        assert {r.symbol for r in registry.QUERIES[name](spark, DATA).select("symbol").distinct().collect()} == want


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_library_does_not_need_the_llm_folder():
    import subprocess
    import sys

    code = "import sys\nfor n in ('tickloom.llm', 'corpus_pipeline'): sys.modules[n] = None\nimport __spark_entry__ as e\nassert 'time_bars' in e.queries() and not any(q.startswith('op1') for q in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", ["volatility", "illiquidity"])
def test_zero_prices_equal_sql(spark, tmp_path, name):
    con, path = duckdb.connect(), str(tmp_path / "events.parquet")
    con.execute(f"COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE value END AS value, props FROM read_parquet('{DATA}/events.parquet')) TO '{path}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}')")
    mine, theirs = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.SQL[name])
    columns = [x[0] for x in theirs.description]
    said = lambda rows: sorted([tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows])
    want = said(theirs.fetchall())
    assert said(mine.select(*columns).collect()) == want and any(v in ("inf", "nan") for r in want for v in r)


def test_equal_issuers_rank_equally(spark, tmp_path):
    con = duckdb.connect()
    shift = {"lineitem": "l_suppkey + 1000 * i AS l_suppkey, l_partkey + 1000000 * i AS l_partkey", "part": "p_partkey + 1000000 * i AS p_partkey", "supplier": "s_suppkey + 1000 * i AS s_suppkey"}
    for name, moved in shift.items():
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM read_parquet('{DATA}/{name}.parquet') t, range(4) r(i) ORDER BY hash(i, t)) TO '{tmp_path}/{name}.parquet'")
    out = registry.QUERIES["screening"](spark, str(tmp_path)).toPandas()
    by = out.groupby(out.ticker % 1000)
    assert len(out) > 4 and (by.size() == 4).all() and (by.pr_margin.nunique() == 1).all() and (by.score.nunique() == 1).all()


def test_exact_sums_hang_on_no_order(spark):
    from pyspark.sql import functions as F

    from tickloom.functions.windows import exact_sum

    fine, inf = [0.1, 0.2, 0.3, 1e5, 4567.8912, -0.1], float("inf")
    rows = [("up", x) for x in fine] + [("down", x) for x in fine[::-1]] + [("fine", 1e-9), ("fine", None), ("inf", inf), ("inf", 1.0), ("null", None), ("large", 1e12), ("large", 0.5)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k string, x double").coalesce(1).groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert got == {"up": 104568.3912, "down": 104568.3912, "fine": 1e-9, "inf": inf, "null": None, "large": 1000000000000.5}
