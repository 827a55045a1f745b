"""Option pricing, greeks, implied volatility and dealer exposure.

A chain has a row for each contract: underlying, strike, option_type (C or P), open_interest,
iv, tte (years), spot, r, q, multiplier[, bid, ask, last]. Gamma and vega are closed-form
expressions; what needs the normal distribution function is a vectorised UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_pdf

c = F.col
NAMES = ("price", "delta", "gamma", "vega", "theta", "rho", "vanna", "charm", "vomma", "speed")


def black_scholes(s, k, t, r, q, sigma, call) -> dict[str, np.ndarray]:
    """Price and greeks with carry q. Without time or volatility: intrinsic value, greeks 0."""
    s, k, t, r, q, sigma, call = np.broadcast_arrays(*(np.asarray(x, float) for x in (s, k, t, r, q, sigma, call)))
    live = (t > 0) & (sigma > 0) & (s > 0) & (k > 0)
    safe = lambda x: np.where(live, x, 1.0)
    S, K, T, V = safe(s), safe(k), safe(t), safe(sigma)
    root = np.sqrt(T)
    d1 = (np.log(S / K) + (r - q + 0.5 * V**2) * T) / (V * root)
    d2 = d1 - V * root
    eq, er, pdf, sign = np.exp(-q * T), np.exp(-r * T), normal_pdf(d1), np.where(call > 0, 1.0, -1.0)
    n1, n2 = normal_cdf(sign * d1), normal_cdf(sign * d2)
    gamma, vega = eq * pdf / (S * V * root), S * eq * pdf * root
    drift = eq * pdf * (2 * (r - q) * T - d2 * V * root) / (2 * T * V * root)
    out = {
        "price": sign * (S * eq * n1 - K * er * n2),
        "delta": sign * eq * n1,
        "gamma": gamma,
        "vega": vega,
        "theta": -S * eq * pdf * V / (2 * root) - sign * r * K * er * n2 + sign * q * S * eq * n1,
        "rho": sign * K * T * er * n2,
        "vanna": -eq * pdf * d2 / V,
        "charm": sign * q * eq * n1 - drift,
        "vomma": vega * d1 * d2 / V,
        "speed": -gamma / S * (d1 / (V * root) + 1),
    }
    rest = np.where(call > 0, np.maximum(s - k, 0), np.maximum(k - s, 0))
    return {n: np.where(live, v, rest if n == "price" else 0.0) for n, v in out.items()}


def implied_volatility(price, s, k, t, r, q, call, tolerance: float = 1e-8, steps: int = 100) -> np.ndarray:
    """Newton steps kept inside a shrinking bracket; NaN outside the no-arbitrage bounds."""
    price, s, k, t, r, q, call = np.broadcast_arrays(*(np.asarray(x, float) for x in (price, s, k, t, r, q, call)))
    spot, strike = s * np.exp(-q * t), k * np.exp(-r * t)
    low_price = np.where(call > 0, np.maximum(spot - strike, 0), np.maximum(strike - spot, 0))
    able = (t > 0) & (price > low_price) & (price < np.where(call > 0, spot, strike))
    low, high = np.full(price.shape, 1e-6), np.full(price.shape, 5.0)
    with np.errstate(all="ignore"):
        x = np.clip(np.sqrt(np.abs(np.log(s / k) + r * t) * 2 / np.where(t > 0, t, 1.0)), 0.05, 2.0)
        for _ in range(steps):
            made = black_scholes(s, k, t, r, q, x, call)
            gap = made["price"] - price
            high, low = np.where(gap > 0, x, high), np.where(gap > 0, low, x)
            step = x - gap / made["vega"]
            x = np.where((step > low) & (step < high), step, (low + high) / 2)
            if np.all(~able | (np.abs(gap) < tolerance)):
                break
    return np.where(able, x, np.nan)


def with_greeks(chain: DataFrame, sigma: str = "iv") -> DataFrame:
    """Adds price and the nine greeks."""
    fields = ", ".join(f"{n} double" for n in NAMES)

    @F.pandas_udf(fields)
    def greeks(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, v: pd.Series, call: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(black_scholes(s, k, t, r, q, v, call))

    args = [c(x).cast("double") for x in ("spot", "strike", "tte", "r", "q", sigma)]
    return chain.withColumn("_g", greeks(*args, (c("option_type") == "C").cast("double"))).select(*chain.columns, "_g.*")


def mid_price(chain: DataFrame) -> Column:
    """Mean of bid and ask, the last price where either isn't positive."""
    return F.when((c("bid") > 0) & (c("ask") > 0), (c("bid") + c("ask")) / 2).otherwise(c("last"))


def with_implied_vol(chain: DataFrame, price: Column | None = None) -> DataFrame:
    @F.pandas_udf("double")
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, call: pd.Series) -> pd.Series:
        return pd.Series(implied_volatility(p, s, k, t, r, q, call))

    value = mid_price(chain) if price is None else price
    args = [c(x).cast("double") for x in ("spot", "strike", "tte", "r", "q")]
    out = chain.withColumn("implied_vol", solve(value.cast("double"), *args, (c("option_type") == "C").cast("double")))
    return out.withColumn("implied_vol", F.when(~F.isnan("implied_vol"), c("implied_vol")))


def time_to_expiry(expiry: Column, as_of: Column) -> Column:
    """Years, ACT/365.25, none negative."""
    return F.greatest(F.datediff(expiry, as_of) / 365.25, F.lit(0.0))


def parse_occ(symbol: Column) -> dict[str, Column]:
    """Root, expiry, type and strike of an OCC option symbol."""
    part = lambda i: F.regexp_extract(symbol, r"^([A-Z]+)\s*(\d{6})([CP])(\d{8})$", i)
    return {"root": part(1), "expiry": F.to_date(F.nullif(part(2), F.lit("")), "yyMMdd"), "option_type": part(3), "strike": F.nullif(part(4), F.lit("")).cast("double") / 1000}


def _gamma(spot: Column, sigma: str) -> Column:
    """Gamma in expressions."""
    v, t = c(sigma), c("tte")
    live = (t > 0) & (v > 0) & (spot > 0) & (c("strike") > 0)
    scale = F.when(live, v * F.sqrt(t))
    d1 = (F.ln(spot / c("strike")) + (c("r") - c("q") + 0.5 * v * v) * t) / scale
    return F.when(live, F.exp(-c("q") * t - 0.5 * d1 * d1) / math.sqrt(2 * math.pi) / (spot * scale)).otherwise(0.0)


def dealer_sign(convention: str = "classic", custom: str | None = None) -> Column:
    """Classic: dealers are short calls and long puts."""
    if convention == "custom":
        return c(custom)
    return F.when(c("option_type") == "C", -1.0).otherwise(1.0)


def _gex(spot: Column, sigma: str, sign: Column) -> Column:
    return _gamma(spot, sigma) * c("multiplier") * c("open_interest") * sign * spot * spot * 0.01


def gamma_exposure(chain: DataFrame, sigma: str = "iv", sign: Column | None = None) -> DataFrame:
    """(underlying, strike, gex, call_gex, put_gex, call_oi, put_oi)."""
    sign = dealer_sign() if sign is None else sign
    call = c("option_type") == "C"
    rows = chain.withColumn("_gex", _gex(c("spot"), sigma, sign))
    side = lambda value, which: F.sum(F.when(call if which else ~call, value).otherwise(0.0))
    return rows.groupBy("underlying", "strike").agg(F.sum("_gex").alias("gex"), side(c("_gex"), True).alias("call_gex"), side(c("_gex"), False).alias("put_gex"), side(c("open_interest"), True).alias("call_oi"), side(c("open_interest"), False).alias("put_oi"))


def aggregate_exposure(chain: DataFrame, sigma: str = "iv", sign: Column | None = None) -> DataFrame:
    """Gamma, delta, vanna and charm exposure by strike."""
    rows = with_greeks(chain, sigma).withColumn("_w", c("multiplier") * c("open_interest") * (dealer_sign() if sign is None else sign))
    s = c("spot")
    return rows.groupBy("underlying", "strike").agg(F.sum(c("gamma") * c("_w") * s * s * 0.01).alias("gex"), F.sum(c("delta") * c("_w") * s).alias("dex"), F.sum(c("vanna") * c("_w") * s * 0.01).alias("vex"), F.sum(c("charm") * c("_w") * s / 365.25).alias("charm"))


def walls(chain: DataFrame, sigma: str = "iv") -> DataFrame:
    """(underlying, call_wall, put_wall): strikes with most call and put gamma; the lowest on ties."""
    rows = gamma_exposure(chain, sigma)
    low = (-c("strike")).alias("s")
    return rows.groupBy("underlying").agg(F.min_by("strike", F.struct("call_gex", "strike")).alias("call_wall"), F.max_by("strike", F.struct(c("put_gex"), low)).alias("put_wall"))


def gex_profile(chain: DataFrame, span: float = 0.15, n: int = 201, sigma: str = "iv", sign: Column | None = None) -> DataFrame:
    """(underlying, place, level, gex): exposure on a grid of n spots within the span of the spot."""
    sign = dealer_sign() if sign is None else sign
    step = 2 * span / (n - 1)
    rows = chain.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("level", c("spot") * (1 - span + c("place") * step))
    return rows.withColumn("_x", _gex(c("level"), sigma, sign)).groupBy("underlying", "place").agg(F.first("level").alias("level"), F.sum("_x").alias("gex"))


def zero_gamma(chain: DataFrame, span: float = 0.2, n: int = 401, sigma: str = "iv", sign: Column | None = None) -> DataFrame:
    """(underlying, zero_gamma): the first level where the exposure changes its sign, interpolated; null if none does."""
    rows = gex_profile(chain, span, n, sigma, sign)
    w = Window.partitionBy("underlying").orderBy("place")
    rows = rows.withColumns({"_g": F.lead("gex").over(w), "_l": F.lead("level").over(w)})
    level = F.when(c("gex") == 0, c("level")).when(c("gex") * c("_g") < 0, c("level") - c("gex") * (c("_l") - c("level")) / F.nullif(c("_g") - c("gex"), F.lit(0.0)))
    return rows.withColumn("_z", level).groupBy("underlying").agg(F.min_by("_z", F.when(c("_z").isNotNull(), c("place"))).alias("zero_gamma"))


def max_pain_curve(chain: DataFrame) -> DataFrame:
    """(underlying, level, pain): what holders get in all if the price ends at each strike.

    Running sums over strikes give every level at once: no strike meets every other.
    """
    call = c("option_type") == "C"
    by = chain.groupBy("underlying", "strike").agg(F.sum(F.when(call, c("open_interest")).otherwise(0.0)).alias("_c"), F.sum(F.when(~call, c("open_interest")).otherwise(0.0)).alias("_p"))
    below = Window.partitionBy("underlying").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("underlying").orderBy(c("strike").desc()).rowsBetween(Window.unboundedPreceding, 0)
    k = c("strike")
    pain = k * F.sum("_c").over(below) - F.sum(k * c("_c")).over(below) + F.sum(k * c("_p")).over(above) - k * F.sum("_p").over(above)
    return by.select("underlying", k.alias("level"), pain.alias("pain"))


def max_pain(chain: DataFrame) -> DataFrame:
    return max_pain_curve(chain).groupBy("underlying").agg(F.min_by("level", F.struct(F.round("pain", 6), "level")).alias("max_pain"))
