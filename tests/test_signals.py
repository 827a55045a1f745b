"""Votes, exits and positions: plain loops, priorities, and that nothing depends on later bars."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.windows import Series
from tickloom.operators import signals
from tickloom.operators.indicators import BARS

S = Series(("k",), ("t",))
MASKS = [*signals.REASONS[:4], "near_put_wall", "cash_defence"]


def test_positions_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    flags = lambda n: [None if x == 2 else bool(x) for x in rng.choice(3, n, p=[0.5, 0.4, 0.1])]
    rows = [(key, i, e, x) for key, n in (("a", 200), ("b", 1), (None, 50)) for i, (e, x) in enumerate(zip(flags(n), flags(n), strict=True))]
    want, now = {}, {}
    for key, i, e, x in rows:
        now[key] = not x if now.get(key) else bool(e)
        want[key, i] = now[key]
    out = signals.held(spark.createDataFrame(rows, "k string, t int, e boolean, x boolean").repartition(3), "e", "x", "long", S)
    assert {(r.k, r.t): r.long for r in out.collect()} == want


def test_reasons_by_priority_and_defences_bar_entries(spark):
    rng = np.random.default_rng(6)
    rows = [("a", i, bool(rng.random() < 0.6), *(bool(x) for x in rng.random(6) < 0.12)) for i in range(400)]
    out = signals.decisions(spark.createDataFrame(rows, "k string, t int, long_entry boolean, " + ", ".join(f"{m} boolean" for m in MASKS)), S)
    now, seen = False, set()
    for r in out.orderBy("t").collect():
        want = next((name for name, m in zip(signals.REASONS, MASKS, strict=True) if r[m]), "none")
        now = want == "none" if now else r.long_entry and not r.near_put_wall and not r.cash_defence
        seen.add(want)
        assert (r.exit_reason, r.long) == (want, now)
    assert seen == {*signals.REASONS, "none"}


def test_a_flag_must_persist(spark):
    values = [0.0, 0.6, 0.7, 0.8, 0.4, 0.9, 0.9, 0.9, None]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, p double")
    out = rows.withColumn("f", signals.persistent(F.col("p") >= 0.5, 3, S)).orderBy("t").collect()
    assert [r.f for r in out] == [False, False, False, True, False, False, False, True, False]


def made(spark, closes, key="a"):
    rng = np.random.default_rng(1)
    rows, last = [], closes[0]
    for i, x in enumerate(closes):
        a, b = rng.random(2)
        rows.append((key, i, float(last), float(max(last, x) + a), float(min(last, x) - b), float(x), float(rng.integers(100, 200))))
        last = x
    return spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double")


def ranges_of(bars):
    """Ranges of 40 bars between the extremes of the ten bars before them."""
    rows = bars.select("symbol", (BARS.number - 1).alias("p"), "high", "low")
    edges = rows.filter("p % 40 >= 30").groupBy("symbol", F.floor(F.col("p") / 40).alias("range")).agg(F.min("low").alias("support"), F.max("high").alias("resistance"))
    return edges.select("symbol", (F.col("range") + 1).alias("range"), ((F.col("range") + 1) * 40).alias("start"), ((F.col("range") + 2) * 40).alias("stop"), "support", "resistance")


def test_nothing_depends_on_later_bars(spark):
    wave = 150 + 6 * np.sin(np.linspace(0, 12 * np.pi, 260)) + np.random.default_rng(2).normal(0, 0.5, 260)
    bars = made(spark, wave)
    cut = bars.filter("ts < 200")
    boxes = ranges_of(bars)
    whole = signals.decisions(signals.votes(bars, boxes)).filter("ts < 200").orderBy("ts").collect()
    part = signals.decisions(signals.votes(cut, boxes.filter("start < 200"))).orderBy("ts").collect()
    assert whole == part and len(part) == 200
    assert any(r.long_entry for r in whole) and len({r.exit_reason for r in whole}) > 2 and any(r.w1_wyckoff_event for r in whole)
    assert not any(r.long_entry for r in whole[: signals.Rules().warm_up]) and all(0 <= r.confluences <= 5 for r in whole)


def test_trends(spark):
    none = made(spark, [1.0]).select("symbol", F.lit(0).alias("range"), F.lit(9_000).alias("start"), F.lit(9_001).alias("stop"), F.lit(1.0).alias("support"), F.lit(2.0).alias("resistance"))
    up = signals.decisions(signals.votes(made(spark, 100 + 0.5 * np.arange(220)), none, signals.Rules(least=2))).collect()
    down = signals.decisions(signals.votes(made(spark, 300 - 0.5 * np.arange(220)), none)).collect()
    assert any(r.long for r in up) and not any(r.long for r in down)
    assert {"hull_flip", "chandelier"} & {r.exit_reason for r in down}


def test_levels_grow_stale(spark):
    bars = spark.sql("SELECT 'a' symbol, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(id) ts, CAST(v AS DOUBLE) close FROM VALUES (0, 100), (1, 99), (2, 98), (3, 99), (5, 98.5), (9, 98) AS t(id, v)")
    levels = spark.sql("SELECT 'a' symbol, TIMESTAMP_NTZ'2024-01-02' ts, 98.6D zero_gamma, 98.2D put_wall UNION ALL SELECT 'a', TIMESTAMP_NTZ'2024-01-06', NULL, NULL")
    out = signals.gex_defence(bars, levels, "2 days").orderBy("ts").collect()
    assert [r.expansion for r in out] == [False, False, True, False, False, False]
    assert [r.near_put_wall for r in out] == [False, True, True, False, False, False]
    assert [r.size for r in out] == [1.0, 1.0, 0.5, 1.0, 1.0, 1.0]


def test_rules_are_checked():
    for wrong in ({"least": 0}, {"least": 6}, {"swing": 0}, {"lookback": -1}):
        with pytest.raises(ValueError):
            signals.Rules(**wrong)
