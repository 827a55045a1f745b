"""Joins of points and intervals, as-of joins with bounds and threshold bars, against plain loops."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, temporal
from tickloom.operators.bars import threshold_ends

DAY = datetime(2024, 1, 1)
POINT, INTERVAL = "symbol string, t bigint, v bigint", "symbol string, start bigint, end bigint, tag bigint"


def points_and_intervals(seed, n=400, m=60):
    rng = np.random.default_rng(seed)
    name = lambda: str(rng.choice(["hot", "hot", "hot", "a", "b"]))
    points = [(name(), int(rng.integers(0, 100)), i // 2) for i in range(n)] + [(None, 5, 0), ("a", None, 0)]
    spans = [(name(), int(a), int(a + rng.integers(-2, 30)), i // 3) for i, a in enumerate(rng.integers(0, 100, m))]
    return points, spans + spans[:5] + [("hot", -5, 200, 99), (None, 0, 9, 0), ("a", None, 9, 0), ("a", 3, None, 0)]


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_covering_equals_all_pairs(spark, most):
    points, spans = points_and_intervals(most)
    want = Counter((*p, a, b, tag) for p in points for k, a, b, tag in spans if None not in (k, a, b, p[1]) and k == p[0] and a <= p[1] < b)
    out = temporal.covering(spark.createDataFrame(points, POINT), spark.createDataFrame(spans, INTERVAL), on="t", most=most)
    assert Counter(tuple(r) for r in out.collect()) == want and len(want) > 1000


def test_covering_of_empty_sides_and_clashes(spark):
    points, spans = (spark.createDataFrame(x, s) for x, s in zip(points_and_intervals(0), (POINT, INTERVAL), strict=True))
    assert temporal.covering(points.limit(0), spans, on="t").count() == temporal.covering(points, spans.limit(0), on="t").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        temporal.covering(points.withColumn("tag", F.lit(1)), spans, on="t")


def test_covering_meets_only_by_run(spark):
    points, spans = (spark.createDataFrame(x, s) for x, s in zip(points_and_intervals(0), (POINT, INTERVAL), strict=True))
    plan = temporal.covering(points, spans, on="t")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) >= 2 and all("_run" in line or "_part" in line for line in joins)


@pytest.mark.parametrize("strict, forward", [(a, b) for a in (False, True) for b in (False, True)])
def test_asof_directions_and_bound(spark, strict, forward):
    at = lambda d: DAY + timedelta(days=d)
    left = spark.createDataFrame([("A", at(d), d) for d in (0, 2, 4, 9)], "symbol string, ts timestamp_ntz, d int")
    right = spark.createDataFrame([("A", at(d), d) for d in (2, 3)], "symbol string, ts timestamp_ntz, v int")
    got = {r.d: r.v for r in temporal.asof_join(left, right, ["v"], strict=strict, forward=forward, within="3 days").collect()}
    want = {}
    for d in (0, 2, 4, 9):
        near = [v for v in (2, 3) if (v >= d if forward else v <= d) and not (strict and v == d)]
        best = (min if forward else max)(near, default=None)
        want[d] = best if best is not None and abs(best - d) <= 3 else None
    assert got == want


def plain_ends(weights, threshold):
    out, total, bar, start = [None] * len(weights), 0, 0, 0
    for i, w in enumerate(weights):
        total += w if w is not None and w > 0 else 0
        if total >= threshold:
            out[start : i + 1] = [bar] * (i + 1 - start)
            total, bar, start = 0, bar + 1, i + 1
    return out


@pytest.mark.parametrize("threshold", [1.0, 100.0, 5_000.0])
@pytest.mark.parametrize("block", [1, 64, 65_536])
def test_threshold_bars_equal_the_loop_at_any_block_size(spark, threshold, block):
    rng = np.random.default_rng(int(threshold))
    rows = [(s, i // 2, i % 2, w) for s, n in (("hot", 700), ("thin", 20), (None, 9)) for i, w in enumerate(rng.integers(-1, 12, n).astype(float).tolist())]
    rows += [("holes", i, 0, w) for i, w in enumerate([None, 3.0, 200.0, None, 0.0, 0.0, 100.0, 1.0])]
    ticks = spark.createDataFrame(rows, "symbol string, ts bigint, seq int, size double").repartition(5)
    out = bars.threshold_bars(ticks, F.col("size"), threshold, block_rows=block)
    got = {(r.symbol, r.ts, r.seq): r.bar for r in out.collect()}
    for s in ("hot", "thin", None, "holes"):
        mine = [r for r in rows if r[0] == s]
        assert [got[r[:3]] for r in mine] == plain_ends([r[3] for r in mine], threshold)


def test_threshold_ends_sum_decimals_exactly():
    assert threshold_ends(np.full(30, 0.1), 1.0).tolist() == [i // 10 for i in range(30)]
    with pytest.raises(ValueError):
        threshold_ends(np.ones(3), 0.0)
    assert threshold_ends(np.zeros(0), 1.0).tolist() == []


def test_a_block_map_is_what_the_block_does():
    rng = np.random.default_rng(1)
    for _ in range(50):
        total = np.concatenate([[0], np.cumsum(rng.integers(0, 6, 40))])
        least, made, left = bars.block_map(total, 11)
        for carry in range(11):
            i = int(np.searchsorted(least, carry, "right")) - 1
            got = (0, carry + total[-1]) if i < 0 else (made[i], left[i])
            bar, held = 0, carry
            for w in np.diff(total):
                bar, held = (bar + 1, 0) if held + w >= 11 else (bar, held + w)
            assert got == (bar, held)


def test_back_adjust_with_actions_at_once_and_before_all_bars(spark):
    days = [DAY + timedelta(days=i) for i in range(6)]
    made = spark.createDataFrame([("A", t, 10.0, 10.0, 10.0, 10.0, 100.0) for t in days], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    acts = [("A", days[3], "split", 2.0, 0.0), ("A", days[3], "cash_div", 1.0, 1.0), ("A", days[0], "cash_div", 1.0, 1.0), ("A", days[3], "split", 2.0, 0.0)]
    out = temporal.back_adjust(made, spark.createDataFrame(acts, "symbol string, ts timestamp_ntz, kind string, ratio double, cash double")).orderBy("ts").collect()
    assert [r.close for r in out] == pytest.approx([4.0] * 3 + [10.0] * 3) and [r.volume for r in out] == pytest.approx([200.0] * 3 + [100.0] * 3)


def test_adaptive_bars_hold_a_batch_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(s, i, 0, float(p), 1.0 + i % 3) for s, n in (("hot", 900), ("thin", 30), (None, 40)) for i, p in enumerate(rng.integers(1, 9, n))]
    ticks = spark.createDataFrame(rows, "symbol string, ts bigint, seq int, price double, size double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    seen = spark.sparkContext.accumulator(0)
    start = bars.imbalance

    def counted(*a):
        ends = start(*a)
        return lambda values: (seen.add(values.shape[1] > 50), ends(values))[1]

    monkeypatch.setattr(bars, "imbalance", counted)
    try:
        got = bars.imbalance_bars(ticks, 4.0, "volume").collect()
        assert seen.value == 0  # no series arrives whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        monkeypatch.undo()
    for s in ("hot", "thin", None):
        mine = [r for r in rows if r[0] == s]
        signs, now = [], 0.0
        for a, b in zip([None, *mine], mine, strict=False):
            now = (np.sign(b[3] - a[3]) or now) if a else 0.0
            signs.append(now)
        ends = bars.imbalance_ends(np.array([x * r[4] for x, r in zip(signs, mine, strict=True)]), 4.0, 0.1, 1)
        want = {int(b): [r for r, e in zip(mine, ends, strict=True) if e == b] for b in set(ends[np.isfinite(ends)])}
        assert {(r.bar, r.ts, r.open, r.close, r.volume) for r in got if r.symbol == s} == {(b, p[-1][1], p[0][3], p[-1][3], sum(x[4] for x in p)) for b, p in want.items()}


def test_coverage_orders_no_ties(spark):
    rows = [(k, DAY + timedelta(days=d), DAY + timedelta(days=d + n)) for k in ("A", None) for d, n in [(0, 1), (2, 1), (2, 3), (4, 1), (9, 1)] * 50]
    df = spark.createDataFrame(rows, "symbol string, start timestamp_ntz, end timestamp_ntz").repartition(7)
    out = temporal.coverage(df)
    assert sorted((str(r.symbol), (r.start - DAY).days, (r.end - DAY).days) for r in out.collect()) == sorted((k, a, b) for k in ("A", "None") for a, b in ((0, 1), (2, 5), (9, 10)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ASC NULLS FIRST, end" not in plan and plan.index("HashAggregate") >= 0  # equal intervals never meet an ORDER BY
