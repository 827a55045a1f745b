"""Inputs of the registered queries, as frames and as SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import hourly_bars, table, ticks

c = F.col

TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS size FROM events)"
BARS = TICKS + """, bars AS (SELECT symbol, b AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(size) AS volume
 FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS b FROM ticks) GROUP BY symbol, b), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"""
QUOTES = TICKS + """, quotes AS (SELECT *, round(mid - 0.05, 6) AS bid, round(mid + 0.05, 6) AS ask FROM (SELECT *, round(price + (seq % 7 - 3) * CAST(0.01 AS DOUBLE), 6) AS mid,
 CAST(seq % 11 + 1 AS DOUBLE) AS bid_size, CAST(seq % 13 + 1 AS DOUBLE) AS ask_size FROM ticks))"""
PANEL = """panel AS (SELECT CAST(n_regionkey AS BIGINT) AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, avg(o_totalprice) AS close
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
ISSUERS = """issuers AS (SELECT l_suppkey AS ticker, year(l_shipdate) AS period, sum(l_extendedprice * (1 - l_discount)) AS revenue, 0.6e0 * sum(l_quantity * p_retailprice) AS cogs,
 sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS units, CAST(count(*) AS DOUBLE) AS n_lines, any_value(s_acctbal) AS cash
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 snap AS (SELECT ticker, period, revenue, cogs, revenue - cogs AS gross_profit, 0.3e0 * revenue AS operating_income, 0.28e0 * revenue AS ebit, 0.33e0 * revenue AS ebitda, 0.28e0 * revenue - tax AS net_income,
 0.01e0 * revenue AS interest_expense, 0.21e0 AS tax_rate, 2 * revenue + abs(cash) AS total_assets, 0.5e0 * revenue + units AS current_assets, abs(cash) AS cash, 10 * units AS inventory, 0.1e0 * revenue AS receivables,
 0.9e0 * revenue AS ppe, revenue AS total_liabilities, 0.4e0 * revenue - units AS current_liabilities, 0.5e0 * revenue AS total_debt, 0.3e0 * revenue + 100 * n_lines AS long_term_debt, revenue + abs(cash) AS equity,
 0.2e0 * revenue AS retained_earnings, 0.25e0 * revenue + tax AS operating_cash_flow, -0.05e0 * revenue AS capex, CAST(NULL AS DOUBLE) AS free_cash_flow, -0.02e0 * revenue AS dividends, 0.05e0 * revenue + n_lines AS depreciation,
 0.1e0 * revenue + units AS sga, 1000 + n_lines AS shares, 20e0 AS price, CAST(NULL AS DOUBLE) AS market_cap FROM issuers),
 prev AS (SELECT *, {} FROM snap WINDOW w AS (PARTITION BY ticker ORDER BY period))"""
CHAIN = """chain AS (SELECT p_brand AS underlying, round(p_retailprice / 25) * 25 AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, 10e0 * p_size AS open_interest,
 0.15e0 + 0.005e0 * p_size AS iv, 7e0 * p_size / 365.25e0 AS tte, avg(p_retailprice) OVER (PARTITION BY p_brand) AS spot, 0.03e0 AS r, 0.01e0 AS q, 100e0 AS multiplier FROM part)"""
MEMBERS = """members AS (SELECT CAST(s_suppkey AS BIGINT) AS symbol, r_name AS index, CAST(TIMESTAMP '1996-01-01' + to_months(CAST(s_suppkey % 12 AS INTEGER)) AS TIMESTAMP) AS "start",
 CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2200-01-01' ELSE CAST(TIMESTAMP '1996-01-01' + to_months(CAST(s_suppkey % 12 + 36 AS INTEGER)) AS TIMESTAMP) END AS "end"
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
DAILY = """daily AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey")).join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy(c("n_regionkey").cast("bigint").alias("symbol"), c("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("close"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    price = c("l_extendedprice") / c("l_quantity")
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("symbol"), c("l_shipdate").alias("ts")).agg(F.avg(price).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"))


def snapshots(spark: SparkSession, d: str, total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Issuers' years; total: how revenue and tax are summed."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
    rows = rows.groupBy(c("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("period")).agg(
        total(c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"), (0.6 * F.sum(c("l_quantity") * c("p_retailprice"))).alias("cogs"), total(c("l_extendedprice") * c("l_tax")).alias("tax"),
        F.sum("l_quantity").alias("units"), F.count(F.lit(1)).cast("double").alias("n_lines"), F.first("s_acctbal").alias("bal"),
    )
    r, none = c("revenue"), F.lit(None).cast("double")
    made = {
        "gross_profit": r - c("cogs"), "operating_income": 0.3 * r, "ebit": 0.28 * r, "ebitda": 0.33 * r, "net_income": 0.28 * r - c("tax"), "interest_expense": 0.01 * r, "tax_rate": F.lit(0.21),
        "total_assets": 2 * r + F.abs("bal"), "current_assets": 0.5 * r + c("units"), "cash": F.abs("bal"), "inventory": 10 * c("units"), "receivables": 0.1 * r, "ppe": 0.9 * r, "total_liabilities": r,
        "current_liabilities": 0.4 * r - c("units"), "total_debt": 0.5 * r, "long_term_debt": 0.3 * r + 100 * c("n_lines"), "equity": r + F.abs("bal"), "retained_earnings": 0.2 * r, "operating_cash_flow": 0.25 * r + c("tax"),
        "capex": -0.05 * r, "free_cash_flow": none, "dividends": -0.02 * r, "depreciation": 0.05 * r + c("n_lines"), "sga": 0.1 * r + c("units"), "shares": 1000 + c("n_lines"), "price": F.lit(20.0), "market_cap": none,
    }
    return rows.select("ticker", "period", "revenue", "cogs", *(v.alias(k) for k, v in made.items()))


def chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    spot = F.avg("p_retailprice").over(Window.partitionBy("p_brand"))
    return p.select(c("p_brand").alias("underlying"), (F.round(c("p_retailprice") / 25) * 25).alias("strike"), F.when(c("p_partkey") % 2 == 0, "C").otherwise("P").alias("option_type"), (10.0 * c("p_size")).alias("open_interest"), (0.15 + 0.005 * c("p_size")).alias("iv"), (7.0 * c("p_size") / 365.25).alias("tte"), spot.alias("spot"), F.lit(0.03).alias("r"), F.lit(0.01).alias("q"), F.lit(100.0).alias("multiplier"))


def members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    begin = F.lit("1996-01-01").cast("date")
    end = F.when(c("s_suppkey") % 3 == 0, F.lit("2200-01-01").cast("timestamp_ntz")).otherwise(F.add_months(begin, (c("s_suppkey") % 12 + 36).cast("int")).cast("timestamp_ntz"))
    return rows.select(c("s_suppkey").cast("bigint").alias("symbol"), c("r_name").alias("index"), F.add_months(begin, (c("s_suppkey") % 12).cast("int")).cast("timestamp_ntz").alias("start"), end.alias("end"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(c("s_suppkey").cast("bigint").alias("symbol"))
    split = s.filter("symbol % 10 = 0").selectExpr("symbol", "TIMESTAMP_NTZ'1998-06-01' AS ts", "'split' AS kind", "2D AS ratio", "0D AS cash")
    paid = s.filter("symbol % 10 = 1").selectExpr("symbol", "TIMESTAMP_NTZ'1997-03-03' AS ts", "'cash_div' AS kind", "1D AS ratio", "5D AS cash")
    return split.unionByName(paid)


__all__ = ["table", "hourly_bars", "ticks", "panel", "daily", "snapshots", "chain", "members", "actions"]
