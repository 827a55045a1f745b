"""Time-series statistics and models for each of many series.

What aggregates can say is an aggregate; tests and fits get one series per group in pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeseries as ts
from ..functions.windows import Series, ratio
from .multivariate import critical

c = F.col


def per_series(df: DataFrame, value: str | Sequence[str], s: Series, f: Callable[..., dict[str, float]], names: Sequence[str]) -> DataFrame:
    """One row for each series with the numbers that f gives for its values in order; NaN becomes null."""
    columns = [value] if isinstance(value, str) else list(value)
    keys, order = list(s.keys), list(s.order)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        made = f(*(part[x].to_numpy(float) for x in columns))
        return pd.DataFrame([{k: part[k].iloc[0] for k in keys} | {n: float(made[n]) for n in names}])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*dict.fromkeys([*keys, *order, *columns])).dropna(subset=columns)
    out = rows.groupBy(*keys).applyInPandas(run, fields + "".join(f", {n} double" for n in names))
    return out.withColumns({n: F.when(~F.isnan(n), c(n)) for n in names})


def autocorrelation(df: DataFrame, value: str, lags: int, s: Series) -> DataFrame:
    """(keys, lag, acf, bound) with divisor n, all lags from one window."""
    stats = df.groupBy(*s.keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    rows = df.join(stats, list(s.keys)).withColumn("_z", c(value) - c("_m"))
    rows = rows.withColumns({f"_p{k}": c("_z") * s.lag("_z", k) for k in range(1, lags + 1)})
    out = rows.groupBy(*s.keys).agg(*(ratio(F.sum(f"_p{k}"), F.first("_n") * F.first("_v")).alias(f"_{k}") for k in range(1, lags + 1)), F.first("_n").alias("_n"))
    return out.select(*s.keys, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), c(f"_{k}").alias("acf")) for k in range(1, lags + 1)))).alias("r"), "_n").select(*s.keys, "r.*", (1.959963984540054 / F.sqrt("_n")).alias("bound"))


def ljung_box(df: DataFrame, value: str, lags: int, s: Series) -> DataFrame:
    rows = autocorrelation(df, value, lags, s).withColumn("_n", F.pow(F.lit(1.959963984540054) / c("bound"), 2))
    return rows.groupBy(*s.keys).agg(F.sum(c("_n") * (c("_n") + 2) * c("acf") ** 2 / (c("_n") - c("lag"))).alias("q"))


def jarque_bera(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.count(value) / 6 * (F.skewness(value) ** 2 + F.kurtosis(value) ** 2 / 4)).alias("jb"))


def realized(df: DataFrame, value: str, s: Series, window: int | None = None) -> DataFrame:
    """Realised variance and bipower variation, in all or trailing."""
    rows = df.withColumns({"_sq": c(value) ** 2, "_bp": np.pi / 2 * F.abs(value) * F.abs(s.lag(value))})
    if window is None:
        return rows.groupBy(*s.keys).agg(F.sum("_sq").alias("rv"), F.sum("_bp").alias("bipower"))
    return rows.withColumns({"rv": s.rolling(F.sum("_sq"), window), "bipower": s.rolling(F.sum("_bp"), window, window + 1)}).drop("_sq", "_bp")


def forecast_errors(df: DataFrame, actual: str, forecast: str, keys: Sequence[str]) -> DataFrame:
    e = c(actual) - c(forecast)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.abs(actual) > 1e-12, F.abs(e / F.nullif(c(actual), F.lit(0.0))))).alias("mape"))


def diagnostics(df: DataFrame, value: str, s: Series) -> DataFrame:
    """Unit-root, variance-ratio, ARCH, Hurst and fractal statistics of each series."""
    names = ["adf", "adf_lags", "adf_p", "kpss", "kpss_p", "pp", "pp_p", "vr", "vr_z", "arch_lm", "arch_p", "jb_p", "lb_p", "hurst_rs", "hurst_dfa", "hurst_var", "fractal", "mf_width"]

    def run(x):
        d = np.diff(x)
        t, p = ts.adf(x)
        vr, z = ts.variance_ratio(x, 5)
        lm, lp = ts.arch_lm(d)
        h = ts.mfdfa(d, np.array([-3.0, 0.0, 3.0]))
        level, pp = ts.kpss(x), ts.phillips_perron(x)
        made = [t, p, ts.df_p_value(t, "c", len(x)), level, ts.kpss_p_value(level), pp, ts.df_p_value(pp, "c", len(x)), vr, z, lm, lp, ts.jarque_bera(d)[1], ts.ljung_box(d, 10)[1], ts.hurst(d), ts.hurst(d, "dfa"), ts.hurst(d, "aggregated"), ts.higuchi(x), h[0] - h[2]]
        return dict(zip(names, made, strict=True))

    return per_series(df, value, s, run, names)


def volatility_models(df: DataFrame, value: str, s: Series, kinds: Sequence[str] = ("garch", "gjr", "egarch")) -> DataFrame:
    names = [f"{k}_{n}" for k in kinds for n in ("omega", "alpha", "beta", "gamma", "log_likelihood")]
    return per_series(df, value, s, lambda r: {f"{k}_{n}": v for k in kinds for n, v in ts.garch_fit(r, k).items()}, names)


def arima(df: DataFrame, value: str, s: Series, p: int = 1, d: int = 0, q: int = 1) -> DataFrame:
    def run(y):
        m = ts.arma_fit(y, p, q, d)
        return {"phi1": m["phi"][0] if p else np.nan, "theta1": m["theta"][0] if q else np.nan, "forecast": ts.arma_forecast(m, 1)[0]} | {n: m[n] for n in ("constant", "sigma2", "log_likelihood", "aic", "bic")}

    return per_series(df, value, s, run, ["constant", "phi1", "theta1", "sigma2", "log_likelihood", "aic", "bic", "forecast"])


def har(df: DataFrame, value: str, s: Series) -> DataFrame:
    return per_series(df, value, s, lambda r: dict(zip(("constant", "day", "week", "month"), ts.har_rv(r), strict=True)), ["constant", "day", "week", "month"])


def switching(df: DataFrame, value: str, s: Series) -> DataFrame:
    def run(y):
        m = ts.markov_switching_ar(y)
        return {"stay_0": m["step"][0, 0], "stay_1": m["step"][1, 1], "level_0": m["coefficients"][0, 0], "level_1": m["coefficients"][1, 0], "log_likelihood": m["log_likelihood"]}

    return per_series(df, value, s, run, ["stay_0", "stay_1", "level_0", "level_1", "log_likelihood"])


def pairs(df: DataFrame, y: str, x: str, s: Series) -> DataFrame:
    """Cointegration, causality, vector autoregression and Kalman hedge of the two columns of each series."""
    names = ["beta", "eg_t", "eg_p", "trace_0", "trace_1", "granger_f", "granger_p", "var_11", "response_12", "kalman_beta"]

    def run(a, b):
        beta, t = ts.engle_granger(a, b)
        trace, _, _ = ts.johansen(np.column_stack([a, b]))
        f, p = ts.granger(a, b, 2)
        _, coefficients, cov = ts.var_fit(np.column_stack([a, b]), 1)
        return dict(zip(names, [beta, t, ts.df_p_value(t, 1, len(a)), trace[0], trace[1], f, p, coefficients[0, 0, 0], ts.impulse_response(coefficients, cov, 3)[3, 0, 1], ts.kalman_hedge(a, b)[0][-1]], strict=True))

    return per_series(df, [y, x], s, run, names)


def variance_paths(df: DataFrame, value: str, s: Series) -> DataFrame:
    """Adds conditional variances of EWMA and GARCH filters at usual parameters, and Kalman levels."""

    def run(r):
        v = float(np.nanvar(r))
        level, smooth = ts.kalman_level(r, 0.01 * v, v)
        r = np.nan_to_num(r)
        return {"ewma": ts.ewma_filter(r), "garch": ts.garch_filter(r, 0.05 * v, 0.05, 0.9), "gjr": ts.garch_filter(r, 0.05 * v, 0.03, 0.9, 0.04), "level": level, "smooth": smooth}

    return s.kernel(df, [value], {n: "double" for n in ("ewma", "garch", "gjr", "level", "smooth")}, run)


def screen_pairs(panel: DataFrame, value: str, s: Series, method: str = "engle_granger", alpha: float = 0.05, max_half_life: float | None = None, all_pairs: bool = False) -> DataFrame:
    """(y, x, beta, statistic, p, half_life, cointegrated) of the cointegrated pairs of the panel's series (of all with
    ``all_pairs``), each pair over the times that both have.

    Engle-Granger: both orientations, the one with the smaller p counts. Johansen: the trace statistic of rank 0; p is null. half_life is
    that of the spread; pairs beyond ``max_half_life`` or without a pull back go if it is given. Each pair is a task's work.
    """
    if method not in ("engle_granger", "johansen"):
        raise ValueError(f"unknown method {method!r}")
    key, time = s.keys[0], s.order[0]
    a = panel.select(time, c(key).alias("y"), c(value).alias("_y"))
    b = panel.select(time, c(key).alias("x"), c(value).alias("_x"))
    rows = a.join(b, time).filter((c("y") < c("x")) & c("_y").isNotNull() & c("_x").isNotNull())
    kind = panel.schema[key].dataType.simpleString()

    def half(gap: np.ndarray) -> float:
        pull = float(np.polyfit(gap[:-1], np.diff(gap), 1)[0])
        return -np.log(2) / pull if pull < 0 else np.inf

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time, kind="stable")
        one, two = part["_y"].to_numpy(float), part["_x"].to_numpy(float)
        names = part["y"].iloc[0], part["x"].iloc[0]
        if method == "johansen":
            trace, _, vectors = ts.johansen(np.column_stack([one, two]))
            beta = -vectors[1, 0] / vectors[0, 0]
            found = [(*names, beta, trace[0], np.nan, half(one - beta * two), bool(trace[0] > critical(2, 1)[1]))]
        else:
            tests = []
            for (n, m), (y, x) in ((names, (one, two)), (names[::-1], (two, one))):
                beta, t = ts.engle_granger(y, x)
                tests.append((n, m, beta, t, ts.df_p_value(t, 1, len(y)), half(y - beta * x)))
            best = min(tests, key=lambda r: r[4])
            found = [(*best, bool(best[4] < alpha))]
        if max_half_life is not None:
            found = [(*r[:6], r[6] and 0 < r[5] <= max_half_life) for r in found]
        return pd.DataFrame([r for r in found if all_pairs or r[6]], columns=["y", "x", "beta", "statistic", "p", "half_life", "cointegrated"])

    out = rows.groupBy("y", "x").applyInPandas(run, f"y {kind}, x {kind}, beta double, statistic double, p double, half_life double, cointegrated boolean")
    return out.withColumn("p", F.when(~F.isnan("p"), c("p")))
