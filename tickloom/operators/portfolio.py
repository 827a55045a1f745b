"""Returns, risk metrics, covariance, momentum factors and optimal portfolios.

The panel is long: keys, time, value. Covariance sums products over an equi-join on time, so
no matrix is needed before the last step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.optimise import projected_gradient, simplex_projection
from ..functions.windows import Series, ratio
from .indicators import BARS

c = F.col


def returns(bars: DataFrame, value: str = "close", s: Series = BARS) -> DataFrame:
    """Simple, log and cumulative returns; the first row of a series, which has none, is dropped."""
    before = s.lag(value)
    rows = bars.withColumns({"ret": ratio(c(value), before) - 1, "log_ret": F.ln(ratio(c(value), before)), "_first": F.first(value).over(s.so_far)})
    return rows.withColumn("cum_ret", ratio(c(value), c("_first")) - 1).filter("ret is not null").drop("_first")


def metrics(rets: DataFrame, value: str = "ret", risk_free: float = 0.0, periods: int = 252, confidence: float = 0.95, s: Series = BARS) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar, value at risk and shortfall of each series.

    Ratios over a risk of zero are 0 (Sharpe) or infinite (Sortino, Calmar).
    """
    rate = risk_free / periods
    rows = rets.withColumn("_wealth", F.exp(s.running(F.sum(F.ln(1 + c(value))))))
    rows = rows.withColumn("_peak", F.greatest(s.running(F.max("_wealth")), F.lit(1.0)))
    quantile = rows.groupBy(*s.keys).agg(F.percentile(value, F.lit(1 - confidence)).alias("_q"))
    rows = rows.join(quantile, list(s.keys))
    excess = c(value) - rate
    out = rows.groupBy(*s.keys).agg(
        F.count(value).alias("n"), F.sum(F.ln(1 + c(value))).alias("_log"), F.stddev_samp(value).alias("_sd"), F.avg(excess).alias("_mean"),
        F.avg(F.when(excess < 0, excess**2)).alias("_down"), F.max(1 - ratio(c("_wealth"), c("_peak"))).alias("max_drawdown"),
        (-F.first("_q")).alias("var"), (-F.avg(F.when(c(value) <= c("_q"), c(value)))).alias("cvar"),
    )
    infinite = F.lit(float("inf"))
    year = F.exp(c("_log") * periods / c("n")) - 1
    return out.select(
        *s.keys, "n", (F.exp("_log") - 1).alias("total_return"), year.alias("annual_return"), (c("_sd") * periods**0.5).alias("annual_volatility"),
        F.when(c("_sd") < 1e-12, 0.0).otherwise(c("_mean") / F.nullif(c("_sd"), F.lit(0.0)) * periods**0.5).alias("sharpe"),
        F.when(c("_down").isNull(), infinite).otherwise(c("_mean") / F.sqrt(F.nullif(c("_down"), F.lit(0.0))) * periods**0.5).alias("sortino"),
        "max_drawdown", F.when(c("max_drawdown") < 1e-12, infinite).otherwise(year / F.nullif(c("max_drawdown"), F.lit(0.0))).alias("calmar"), "var", "cvar",
    )


def covariance(panel: DataFrame, key: str = "symbol", time: str = "ts", value: str = "ret", halflife: float | None = None) -> DataFrame:
    """(i, j, cov, corr) of all series over the times that both have; with ``halflife`` weights that
    halve over so many times back from the latest one."""
    rows = panel.select(c(key).alias("k"), c(time).alias("t"), c(value).alias("x")).filter("x is not null")
    if halflife is not None:
        ages = rows.select("t").distinct().withColumn("w", F.pow(F.lit(2.0), -(F.row_number().over(Window.orderBy(c("t").desc())) - 1) / halflife))
        rows = rows.join(ages, "t")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    a, b = rows.select(c("k").alias("i"), "t", "w", c("x").alias("x")), rows.select(c("k").alias("j"), "t", c("x").alias("y"))
    sums = a.join(b, "t").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("_w"), F.sum(c("w") * c("x")).alias("_x"), F.sum(c("w") * c("y")).alias("_y"), F.sum(c("w") * c("x") * c("y")).alias("_xy"), F.sum(c("w") * c("x") ** 2).alias("_xx"), F.sum(c("w") * c("y") ** 2).alias("_yy"))
    centred = ratio(c("_xy"), c("_w")) - ratio(c("_x") * c("_y"), c("_w") ** 2)
    spread = F.sqrt(F.greatest((ratio(c("_xx"), c("_w")) - ratio(c("_x"), c("_w")) ** 2) * (ratio(c("_yy"), c("_w")) - ratio(c("_y"), c("_w")) ** 2), F.lit(0.0)))
    scale = ratio(c("n").cast("double"), c("n") - 1) if halflife is None else F.lit(1.0)
    return sums.select("i", "j", "n", (centred * scale).alias("cov"), (centred / F.nullif(spread, F.lit(0.0))).alias("corr"))


def time_series_momentum(bars: DataFrame, lookback: int = 252, vol_window: int = 60, target: float = 0.15, cap: float = 3.0, periods: float = 252.0, s: Series = BARS) -> DataFrame:
    """Sign of the trailing return, scaled to a target volatility; factor_ret is the next bar's return times the position."""
    rows = bars.withColumns({"_r": ratio(c("close"), s.lag("close")) - 1, "signal": F.signum(F.ln(ratio(c("close"), s.lag("close", lookback))))})
    sd = F.stddev_pop("_r").over(s.rows(vol_window)) * periods**0.5
    scaled = c("signal") * F.least(F.lit(cap), F.lit(target) / F.nullif(sd, F.lit(0.0)))
    ready = s.number > vol_window
    rows = rows.withColumn("weight", F.coalesce(F.when(ready & (sd > 0), scaled), F.lit(0.0)))
    return rows.withColumn("factor_ret", s.lag("weight") * c("_r")).drop("_r")


def cross_sectional_momentum(bars: DataFrame, lookback: int = 252, skip: int = 21, holding: int = 21, n_quantiles: int = 5, s: Series = BARS) -> DataFrame:
    """(keys, ts, weight, factor_ret): at every ``holding``-th time the top and bottom quantiles by formation
    return get equal weights, held until the next time. Times are those that series share."""
    times = bars.select("ts").distinct().withColumn("_t", F.dense_rank().over(Window.orderBy("ts")) - 1)
    rows = bars.select(*s.keys, "ts", "close").join(times, "ts")
    rows = rows.withColumns({"_form": F.ln(ratio(s.lag("close", skip), s.lag("close", skip + lookback))), "_r": ratio(c("close"), s.lag("close")) - 1})
    deal = (c("_t") >= lookback + skip) & ((c("_t") - lookback - skip) % holding == 0) & c("_form").isNotNull()
    at = Window.partitionBy("ts", deal)
    place, n = F.row_number().over(at.orderBy("_form", *s.keys)), F.count(F.lit(1)).over(at)
    side = F.greatest(F.floor(n / n_quantiles), F.lit(1))
    weight = F.when(deal & (n >= 2), F.when(place > n - side, 1.0 / side).when(place <= side, -1.0 / side).otherwise(0.0))
    rows = rows.withColumn("_w", weight)
    rows = rows.withColumn("weight", F.coalesce(s.carried(c("_w")), F.lit(0.0)))
    return rows.withColumn("factor_ret", s.lag("weight") * c("_r")).select(*s.keys, "ts", "weight", "factor_ret")


def ledoit_wolf(panel: DataFrame, key: str = "symbol", time: str = "ts", value: str = "ret") -> DataFrame:
    """(i, j, cov): covariance shrunk towards a multiple of the identity, over times that all series have."""
    keys = sorted(r[0] for r in panel.select(key).distinct().collect())

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.pivot_table(index=time, columns=key, values=value).reindex(columns=keys).dropna().to_numpy(float)
        cov, shrink = ledoit_wolf_matrix(x)
        return pd.DataFrame([(a, b, cov[i, j], shrink) for i, a in enumerate(keys) for j, b in enumerate(keys)], columns=["i", "j", "cov", "shrinkage"])

    kind = panel.schema[key].dataType.simpleString()
    return panel.select(key, time, value).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: run(p), f"i {kind}, j {kind}, cov double, shrinkage double")


def ledoit_wolf_matrix(x: np.ndarray) -> tuple[np.ndarray, float]:
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    distance = ((s - mu * np.eye(p)) ** 2).sum() / p
    if distance < 1e-20:
        return s, 0.0
    noise = ((x**2).sum(axis=1) ** 2).sum() / n**2 - (s**2).sum() / n
    share = min(max(noise / p, 0.0), distance) / distance
    return (1 - share) * s + share * mu * np.eye(p), float(share)


# Optimal portfolios: on arrays of a handful of assets -------------------------------------------


def min_variance(cov: np.ndarray, long_only: bool = True) -> np.ndarray:
    n = len(cov)
    low = 0.0 if long_only else -1.0
    rate = 1 / (2 * np.linalg.eigvalsh(cov)[-1])
    return projected_gradient(lambda w: 2 * cov @ w, np.full(n, 1 / n), lambda w: simplex_projection(w, low), rate)


def _tilted(mu: np.ndarray, cov: np.ndarray, tilt: float, long_only: bool) -> np.ndarray:
    """Least variance minus ``tilt`` times the expected return: a point of the efficient frontier."""
    n, low = len(mu), 0.0 if long_only else -1.0
    rate = 1 / (2 * np.linalg.eigvalsh(cov)[-1])
    return projected_gradient(lambda w: 2 * cov @ w - tilt * mu, np.full(n, 1 / n), lambda w: simplex_projection(w, low), rate)


def efficient_return(mu: np.ndarray, cov: np.ndarray, target: float, long_only: bool = True) -> np.ndarray:
    """Least variance with an expected return of ``target``, by bisection on the tilt."""
    a, b = 0.0, 1.0
    while _tilted(mu, cov, b, long_only) @ mu < target and b < 1e6:
        b *= 4
    for _ in range(30):
        mid = (a + b) / 2
        a, b = (mid, b) if _tilted(mu, cov, mid, long_only) @ mu < target else (a, mid)
    return _tilted(mu, cov, b, long_only)


def efficient_frontier(mu: np.ndarray, cov: np.ndarray, n_points: int = 50, long_only: bool = True) -> list[tuple[float, float, np.ndarray]]:
    """(return, volatility, weights) from the least-variance portfolio's return to the largest."""
    low = float(min_variance(cov, long_only) @ mu)
    made = [efficient_return(mu, cov, float(t), long_only) for t in np.linspace(low, float(mu.max()), n_points)]
    return [(float(w @ mu), float(np.sqrt(w @ cov @ w)), w) for w in made]


def max_sharpe(mu: np.ndarray, cov: np.ndarray, risk_free: float = 0.0, long_only: bool = True, n_points: int = 25) -> np.ndarray:
    """The frontier's point with the best ratio, on a refined grid of tilts."""
    scale = float(np.trace(cov) / len(mu) / max(np.abs(mu).max(), 1e-12))
    quality = lambda w: (w @ mu - risk_free) / max(np.sqrt(w @ cov @ w), 1e-12)
    low, high = 1e-3 * scale, 1e3 * scale
    for _ in range(2):
        tilts = np.geomspace(low, high, n_points)
        made = [_tilted(mu, cov, t, long_only) for t in tilts]
        k = int(np.argmax([quality(w) for w in made]))
        low, high = tilts[max(k - 1, 0)], tilts[min(k + 1, n_points - 1)]
    return made[k]


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Equal contributions to risk, by cyclical coordinate descent."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        before = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - before).max() < 1e-14:
            break
    return w / w.sum()


def optimal_portfolios(panel: DataFrame, key: str = "symbol", time: str = "ts", value: str = "ret", periods: int = 252) -> DataFrame:
    """(method, key, weight) of the least-variance, best-Sharpe and equal-risk portfolios of a panel's series."""
    kind = panel.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index=time, columns=key, values=value).dropna()
        mu, cov = wide.mean().to_numpy() * periods, np.cov(wide.to_numpy().T) * periods
        made = {"min_variance": min_variance(cov), "max_sharpe": max_sharpe(mu, cov), "risk_parity": risk_parity(cov)}
        return pd.DataFrame([(m, k, float(x)) for m, w in made.items() for k, x in zip(wide.columns, w, strict=True)], columns=["method", key, "weight"])

    return panel.select(key, time, value).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: run(p), f"method string, {key} {kind}, weight double")


def drawdown(value: Column, s: Series = BARS) -> Column:
    """Share lost since the highest wealth so far."""
    return 1 - ratio(value, s.running(F.max(value)))
