"""Gaps, commits and crashes of incremental loads."""

import datetime as dt
import random

import pandas as pd
import pytest

from tickloom.operators.temporal import uncovered
from tickloom.sources import loading

DAY = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
ASKED = "symbol string, start timestamp_ntz, end timestamp_ntz"


def ask(spark, *ranges):
    return spark.createDataFrame([(s, DAY(a), DAY(b)) for s, a, b in ranges], ASKED)


def fetch_days(symbol, start, end, interval):
    """A bar a day but on days 10 to 19."""
    days = [d for d in pd.date_range(start, end, freq="1D", inclusive="left") if not 10 <= (d - DAY(0)).days < 20]
    return pd.DataFrame({"ts": days, "open": 1.0, "high": 2.0, "low": 0.5, "close": [float((d - DAY(0)).days) for d in days], "volume": 10.0})


def days_of(df):
    return sorted((r.symbol, (r.ts - DAY(0)).days) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return loading.GapStore(spark, str(tmp_path / "store"))


def test_a_second_load_fetches_nothing(spark, store):
    calls = spark.sparkContext.accumulator(0)

    def counted(*args):
        calls.add(1)
        return fetch_days(*args)

    vendor = loading.by_gap(counted)
    first = loading.load(store, vendor, ask(spark, ("a", 5, 12), ("b", 0, 3)), "1d")
    assert days_of(first) == [("a", d) for d in range(5, 10)] + [("b", d) for d in range(3)]
    seen = calls.value
    assert seen == 2
    assert days_of(loading.load(store, vendor, ask(spark, ("a", 6, 12), ("b", 1, 2)), "1d")) == [("a", d) for d in range(6, 10)] + [("b", 1)]
    assert calls.value == seen  # the empty days 10 and 11 are known to be empty
    wider = ask(spark, ("a", 0, 25), ("a", 20, 30), ("c", 4, 4))
    assert sorted((r.symbol, (r.start - DAY(0)).days, (r.end - DAY(0)).days) for r in store.gaps(wider, "1d").collect()) == [("a", 0, 5), ("a", 12, 30)]
    assert days_of(loading.load(store, vendor, wider, "1d")) == [("a", d) for d in [*range(10), *range(20, 30)]]
    assert calls.value == seen + 2
    assert store.gaps(wider, "1h").count() == 1 and [(r.symbol, (r.end - DAY(0)).days) for r in store.covered("1d").orderBy("symbol").collect()] == [("a", 30), ("b", 3)]


def test_long_gaps_are_cut(spark, store):
    out = loading.load(store, loading.by_gap(fetch_days), ask(spark, ("a", 0, 1000)), "1d")
    assert len(days_of(out)) == 990 and len(set(days_of(out))) == 990


def test_a_crash_before_the_commit_loses_nothing(spark, store, monkeypatch):
    asked, vendor = ask(spark, ("a", 0, 5)), loading.by_gap(fetch_days)

    def die(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", die)
        with pytest.raises(RuntimeError):
            loading.load(store, vendor, asked, "1d")
    assert store.get(asked, "1d").count() == 0 and store.gaps(asked, "1d").count() == 1
    assert days_of(loading.load(store, vendor, asked, "1d")) == [("a", d) for d in range(5)]


def test_two_loads_of_the_same_gap(spark, store):
    """Both have fetched before either commits; the later commit's bars stand, each once."""
    gaps = ask(spark, ("a", 0, 5))
    bars = loading.by_gap(fetch_days)(gaps.selectExpr("*", "'1d' AS interval"))
    one, two = store.put(bars, "1d"), store.put(bars.withColumn("close", bars.close + 100), "1d")
    store.commit(gaps, "1d", one)
    store.commit(gaps, "1d", two)
    got = store.get(gaps, "1d").collect()
    assert sorted(r.close for r in got) == [100, 101, 102, 103, 104] and store.covered("1d").count() == 1


def test_uncovered_equals_a_plain_count(spark):
    rng = random.Random(3)
    draw = lambda: [(rng.choice("ab"), a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 60) for _ in range(14))]
    for _ in range(3):
        asked, have = draw(), draw()
        out = uncovered(ask(spark, *asked), ask(spark, *have)).collect()
        found = sorted((r.symbol, d) for r in out for d in range((r.start - DAY(0)).days, (r.end - DAY(0)).days))
        want = {(s, d) for s, a, b in asked for d in range(a, b)} - {(s, d) for s, a, b in have for d in range(a, b)}
        assert found == sorted(want)
        starts = {(r.symbol, r.start) for r in out}
        assert not starts & {(r.symbol, r.end) for r in out}  # touching parts are one


def test_table_vendor(spark):
    bars = spark.createDataFrame([("a", DAY(i), float(i)) for i in range(10)] + [("b", DAY(3), 1.0)], "symbol string, ts timestamp_ntz, close double").selectExpr("*", "close AS open", "close AS high", "close AS low", "1D AS volume")
    assert days_of(loading.from_table(bars)(ask(spark, ("a", 1, 3), ("a", 7, 20), ("c", 0, 9)))) == [("a", 1), ("a", 2), ("a", 7), ("a", 8), ("a", 9)]
