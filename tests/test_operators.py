"""Operators on small frames: stores, streams, edge cases, walk forward."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.windows import Series
from tickloom.operators import backtest, bars, indicators, options, strategies, temporal
from tickloom.sources.tables import BarStore, normalise_bars
from tickloom.streaming.bars import streaming_ema, streaming_time_bars


def made(spark, n=60, symbol="A", start=datetime(2024, 1, 1)):
    rows = [(symbol, start + timedelta(days=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1000.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_store_upserts(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.put(made(spark, 10), "1d")
    store.put(made(spark, 3, start=datetime(2024, 1, 9)).withColumn("close", F.lit(1.0)), "1d")
    rows = store.get("A", "1d", "2024-01-01", "2025-01-01").collect()
    assert len(rows) == 11 and [r.close for r in rows[-3:]] == [1.0] * 3 and rows[0].close == 100.5
    assert store.coverage("1d").first().n_bars == 11


def test_headers_are_normalised(spark):
    raw = spark.createDataFrame([("2024-01-01", 1, 2, 0, 1, 5)], "Date string, Open int, High int, Low int, Close int, Volume int")
    assert normalise_bars(raw, "X").first().symbol == "X"
    with pytest.raises(ValueError):
        normalise_bars(raw.drop("Open"), "X")


def test_windows_are_checked_and_short_series_are_null(spark):
    with pytest.raises(ValueError):
        indicators.sma(made(spark), "close", 0)
    out = indicators.recursive(made(spark, 5)).collect()
    assert all(r.ema is None and r.adx is None for r in out)
    assert indicators.sma(made(spark, 0), "close", 3).count() == 0


def test_order_of_rows_does_not_matter(spark):
    a = indicators.recursive(made(spark)).orderBy("ts").toPandas()
    b = indicators.recursive(made(spark).orderBy(F.rand(1))).orderBy("ts").toPandas()
    assert a.equals(b)


def test_split_leaves_the_ex_date(spark):
    actions = spark.createDataFrame([("A", datetime(2024, 1, 5), "split", 2.0, 0.0)], "symbol string, ts timestamp_ntz, kind string, ratio double, cash double")
    out = temporal.apply_splits(made(spark, 6), actions).orderBy("ts").collect()
    assert out[3].close == 103.5 / 2 and out[3].volume == 2000 and out[4].close == 104.5


def test_missing_coverage(spark):
    rows = spark.createDataFrame([("A", datetime(2024, 1, 1), datetime(2024, 1, 3)), ("A", datetime(2024, 1, 3), datetime(2024, 1, 5)), ("A", datetime(2024, 1, 7), datetime(2024, 1, 8))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert temporal.coverage(rows).count() == 2
    gaps = [(r.gap_start.day, r.gap_end.day) for r in temporal.missing(rows, "2024-01-02", "2024-01-10").orderBy("gap_start").collect()]
    assert gaps == [(5, 7), (8, 10)]


def test_occ_symbols(spark):
    row = spark.createDataFrame([("AAPL240119C00150000",)], "s string").select(*(v.alias(k) for k, v in options.parse_occ(F.col("s")).items())).first()
    assert (row.root, str(row.expiry), row.option_type, row.strike) == ("AAPL", "2024-01-19", "C", 150.0)


def test_backtest_fills_on_the_next_open(spark):
    rows = made(spark, 5).withColumns({"run_id": F.lit(1), "weight": F.when(F.col("ts") == F.lit("2024-01-01").cast("timestamp_ntz"), 1.0)})
    trade = backtest.trades(rows, cash=1000.0).collect()
    assert len(trade) == 1 and trade[0].price == 101.0 and trade[0].quantity == np.trunc(1000 / 100.5)
    equity = backtest.backtest(rows, cash=1000.0).orderBy("ts").collect()
    assert equity[-1].equity == pytest.approx(1000 + 9 * (104.5 - 101))


def test_walk_forward(spark):
    make = lambda b, p: strategies.sma_cross(b, p["fast"], p["slow"])
    out = backtest.walk_forward(spark, made(spark, 60), make, {"fast": [2], "slow": [4]}, 30, 15).collect()
    assert [r.fold for r in out] == [0, 1]


def test_streams_equal_batch(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1) + timedelta(minutes=10 * i), i, float(i % 7 + 1), 1.0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double")
    ticks.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_time_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("bars").collect()) == sorted(bars.time_bars(ticks, "1 hour").collect())
    query = streaming_ema(stream, 5).writeStream.format("memory").queryName("ema").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(spark.table("ema").collect(), key=lambda r: r.n)
    s = Series(("symbol",), ("ts", "seq"))
    from tickloom.functions import kernels

    batch = s.kernel(ticks, ["price"], {"ema": "double"}, lambda x: {"ema": kernels.ema(x, 5)}).orderBy(F.col("seq").desc()).first()
    assert last.n == 60 and last.ema == pytest.approx(batch.ema)


def test_zero_prices_and_short_series_divide_nothing(spark):
    from tickloom.operators import micro, portfolio

    rows = made(spark, 40).withColumns({x: F.when(F.dayofmonth("ts") % 7 == 0, 0.0).otherwise(F.col(x)) for x in ("open", "high", "low", "close", "volume")})
    for bars_ in (rows, made(spark, 1), made(spark, 0)):
        for f in (indicators.volatility, indicators.volume_flow, indicators.roc, indicators.cci, micro.illiquidity, micro.vpin, portfolio.returns, lambda b: portfolio.time_series_momentum(b, 5)):
            f(bars_).collect()


def test_late_order_of_ticks_does_not_change_the_stream(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1) + timedelta(minutes=10 * i), i, float(i % 7 + 1), 1.0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double")
    for k in (2, 0, 1):  # the middle comes last
        ticks.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming_ema(stream, 5).writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    value = 0.0
    for i, price in enumerate((r[3] for r in rows), 1):
        value += (price - value) / i if i <= 5 else (price - value) / 3
    last = max(spark.table("late").collect(), key=lambda r: r.n)
    assert last.n == 60 and last.ema == pytest.approx(value)
