"""Market shapes from the star-schema tables, and file sources for bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import time_bars

#: Fixed schema of bars.
BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
#: Headers that bar files use.
HEADERS = {"date": "ts", "datetime": "ts", "timestamp": "ts", "time": "ts", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "symbol": "symbol"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, price, size from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("size"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_bars(ticks(spark, sf_dir), "1 hour")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a synthetic quote around a slowly moving mid and sizes at both sides."""
    t = ticks(spark, sf_dir)
    mid = F.round(F.col("price") + (F.col("seq") % 7 - 3) * 0.01, 6)
    return t.withColumns({"bid": F.round(mid - 0.05, 6), "ask": F.round(mid + 0.05, 6), "bid_size": (F.col("seq") % 11 + 1).cast("double"), "ask_size": (F.col("seq") % 13 + 1).cast("double")})


def normalise_bars(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Renames the usual headers, casts to the bar schema, and checks that no column is missing."""
    found = {HEADERS[c.lower()]: c for c in raw.columns if c.lower() in HEADERS}
    if symbol is not None:
        raw, found["symbol"] = raw.withColumn("symbol", F.lit(symbol)), "symbol"
    missing = [f.name for f in BAR_SCHEMA if f.name not in found]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    return raw.select(*(F.col(found[f.name]).cast(f.dataType).alias(f.name) for f in BAR_SCHEMA))


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, start=None, end=None, kind: str = "parquet") -> DataFrame:
    """Bars of a CSV or Parquet file or folder; start is in, end is out."""
    raw = spark.read.csv(path, header=True) if kind == "csv" else spark.read.parquet(path)
    bars = normalise_bars(raw, symbol)
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


class BarStore:
    """Parquet folder partitioned by symbol, interval and year."""

    SCHEMA = "ts timestamp_ntz, open double, high double, low double, close double, volume double, symbol string, interval string, year int"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def scan(self, symbol: str | None = None, interval: str | None = None) -> DataFrame:
        # given, as partition values such as 1d would be read as numbers
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.root)
        for name, value in (("symbol", symbol), ("interval", interval)):
            rows = rows if value is None else rows.filter(F.col(name) == value)
        return rows

    def get(self, symbol: str, interval: str, start, end) -> DataFrame:
        """Bars with start <= ts < end in order; years outside are pruned."""
        rows = self.scan(symbol, interval).filter((F.col("year") >= F.year(F.lit(start).cast("timestamp_ntz"))) & (F.col("year") <= F.year(F.lit(end).cast("timestamp_ntz"))))
        return rows.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))).orderBy("ts")

    def put(self, bars: DataFrame, interval: str) -> None:
        """Upsert by (symbol, ts): new rows win; only the years that change are rewritten."""
        new = bars.withColumns({"interval": F.lit(interval), "year": F.year("ts")})
        try:
            old = self.scan(interval=interval)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            merged = new
        else:
            touched = new.select("symbol", "year").distinct()
            kept = old.join(touched, ["symbol", "year"], "left_semi").join(new.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
            merged = kept.select(*new.columns).unionByName(new).checkpoint()
        merged.repartition("symbol", "year").sortWithinPartitions("symbol", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval", "year").parquet(self.root)

    def coverage(self, interval: str) -> DataFrame:
        return self.scan(interval=interval).groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_bars"))
