"""Registered queries and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all symbols with moving averages, bands and flow."""
    from ..operators import indicators
    from ..sources.tables import hourly_bars

    bars = hourly_bars(spark, sf_dir)
    return indicators.volume_flow(indicators.bollinger_bands(indicators.sma(bars, "close", 20)))
