"""Vector autoregressions, cointegration ranks and error correction of panels, from moments.

All that these models need of the data are cross products of a row's values, differences and lags. They are one
aggregate over the panel with map-side sums; only the matrices of a group, a few dozen values a side, reach a task
that solves them. Lags come from numbered rows in blocks, so that one panel's history isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import join_on, lagged, numbered

c = F.col

#: Series that a panel may have: critical values go so far, and the moments grow with the square.
MOST_SERIES = 12

#: 10, 5 and 1 % values of Johansen's statistics for 1, 2, ... series without a relation (Osterwald-Lenum
#: 1992). 0: the constant is within the relations, 1: it is free. The published 5 and 1 % values are shared but for one series.
TRACE_10 = {
    0: (2.71, 13.31, 27.16, 44.49, 65.82, 90.39, 118.99, 151.38, 186.54, 226.34, 269.53, 316.55),
    1: (2.69, 13.33, 26.79, 43.95, 64.84, 89.48, 118.50, 150.53, 186.39, 225.85, 269.96, 317.95),
}
TRACE_5 = (None, 15.41, 29.68, 47.21, 68.52, 94.15, 124.24, 156.00, 192.89, 233.13, 277.71, 326.06)
TRACE_1 = (6.65, 20.04, 35.65, 54.46, 76.07, 103.18, 133.57, 168.36, 204.95, 247.18, 293.44, 343.20)
EIGEN_10 = (None, 12.07, 18.60, 24.73, 30.90, 36.76, 42.32, 48.33, 53.98, 59.62, 65.38, 70.60)
EIGEN_5 = (None, 14.07, 20.97, 27.07, 33.46, 39.37, 45.28, 51.42, 57.12, 62.81, 68.83, 74.36)
EIGEN_1 = (6.65, 18.63, 25.52, 32.24, 38.77, 45.10, 51.57, 57.69, 63.71, 69.94, 76.63, 82.45)
#: The values for one series that differ: 10 and 5 %.
ONE_SERIES = {0: (2.71, 3.84), 1: (2.69, 3.76)}


def critical(free: int, constant: int, statistic: str = "trace") -> tuple[float, float, float]:
    """10, 5 and 1 % values for ``free`` series without a relation; statistic: "trace" or "eigen"."""
    i = free - 1
    if statistic == "trace":
        ten, five, one = TRACE_10[constant][i], TRACE_5[i], TRACE_1[i]
    else:
        ten, five, one = EIGEN_10[i], EIGEN_5[i], EIGEN_1[i]
    return (*ONE_SERIES[constant], one) if free == 1 else (ten, five, one)


def cross_products(df: DataFrame, keys: Sequence[str], vector: Column) -> DataFrame:
    """(keys, i, j, s, n) for i <= j: sums of products of the entries of an array column, and the rows; map-side sums first."""
    rows = df.select(*keys, vector.alias("_v"))
    pairs = F.flatten(F.transform("_v", lambda x, i: F.transform(F.slice("_v", i + 1, F.size("_v")), lambda y, k: F.struct(i.alias("i"), (i + k).alias("j"), (x * y).alias("p")))))
    return rows.select(*keys, F.explode(pairs).alias("_e")).groupBy(*keys, c("_e.i").alias("i"), c("_e.j").alias("j")).agg(F.sum("_e.p").alias("s"), F.count(F.lit(1)).alias("n"))


def aligned(panel: DataFrame, names: Sequence, keys: Sequence[str], key: str = "symbol", time: str = "ts", value: str = "close") -> DataFrame:
    """(keys, time, y): the values of the series ``names`` in that order, at the times at which all of them have one."""
    if len(set(names)) != len(names) or not 0 < len(names) <= MOST_SERIES:
        raise ValueError(f"between 1 and {MOST_SERIES} different series")
    named = F.array(*(F.max(F.when(c(key) == n, c(value).cast("double"))) for n in names))
    rows = panel.filter(c(key).isin(list(names))).groupBy(*keys, time).agg(named.alias("y"))
    return rows.filter(F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v)))


def lagged_moments(rows: DataFrame, keys: Sequence[str], lags: int, time: str = "ts", levels: bool = False) -> DataFrame:
    """Cross products of (1, y_t, y_(t-1), ...) with ``levels``, else of (1, Δy_t, y_(t-1), Δy_(t-1), ..., Δy_(t-lags)),
    over the rows of ``aligned`` that have all of these."""
    back = lags if levels else lags + 1
    out = numbered(rows, [time], keys)
    out = lagged(out, "y", back, "_n", keys).withColumnRenamed("y", "y_0").filter(c("_n") >= back)
    less = lambda a, b: F.zip_with(f"y_{a}", f"y_{b}", lambda x, y: x - y)
    parts = [c(f"y_{k}") for k in range(lags + 1)] if levels else [less(0, 1), c("y_1"), *(less(k, k + 1) for k in range(1, lags + 1))]
    return cross_products(out, keys, F.concat(F.array(F.lit(1.0)), *parts))


def _solved(moments: DataFrame, keys: Sequence[str], fields: str, solve: Callable[[np.ndarray, int], pd.DataFrame]) -> DataFrame:
    """``solve(matrix, rows)`` for every group's moments."""
    keys = list(keys)
    flat = moments.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "j", "s")).alias("m"))

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                size = max(e["i"] for e in row.m) + 1
                matrix = np.zeros((size, size))
                for e in row.m:
                    matrix[e["i"], e["j"]] = matrix[e["j"], e["i"]] = e["s"]
                made = solve(matrix, int(row.n))
                for place, k in enumerate(keys):
                    made.insert(place, k, [row[place]] * len(made))
                yield made

    heads = "".join(f"`{k}` {moments.schema[k].dataType.simpleString()}, " for k in keys)
    return flat.select(*keys, "n", "m").mapInPandas(run, heads + fields)


def _without(m: np.ndarray, z: list[int]) -> np.ndarray:
    """The moments of what a regression on the entries z leaves."""
    if not z:
        return m
    return m - m[:, z] @ np.linalg.lstsq(m[np.ix_(z, z)], m[z], rcond=None)[0]


def johansen_solution(m: np.ndarray, n: int, k: int, lags: int, constant: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors (columns, by series) of the reduced rank regression, from moments
    of (1, Δy, y_(t-1), lagged Δy)."""
    new, old, rest = list(range(1, k + 1)), list(range(k + 1, 2 * k + 1)), list(range(2 * k + 1, 2 * k + 1 + k * lags))
    old, rest = ([*old, 0], rest) if constant == 0 else (old, [*rest, 0])
    s = _without(m / n, rest)
    s00, s01, s11 = s[np.ix_(new, new)], s[np.ix_(new, old)], s[np.ix_(old, old)]
    half = np.linalg.inv(np.linalg.cholesky(s11))
    inner = half @ s01.T @ np.linalg.solve(s00, s01) @ half.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return np.clip(values[::-1][:k], 1e-15, 1 - 1e-15), (half.T @ vectors[:, ::-1])[:k, :k]


def johansen(panel: DataFrame, names: Sequence, keys: Sequence[str] = (), lags: int = 1, constant: int = 0, level: float = 0.05, **columns: str) -> DataFrame:
    """One row for each group and r: do the panel's series have more than r cointegrating relations?

    (keys, r, eigenvalue, trace, trace_10, trace_5, trace_1, eigen, eigen_10, eigen_5, eigen_1, rank_trace, rank_eigen, n).
    lags: of the differences. constant: 0 within the relations, 1 free. The ranks are the first r that isn't rejected
    at ``level`` (0.1, 0.05 or 0.01). Groups with no more rows than the regression has columns, or with collinear
    series, give no rows.
    """
    k, at = len(names), {0.1: 0, 0.05: 1, 0.01: 2}[level]

    def solve(m: np.ndarray, n: int) -> pd.DataFrame:
        try:
            values = johansen_solution(m, n, k, lags, constant)[0] if n > len(m) else np.zeros(0)
        except np.linalg.LinAlgError:
            values = np.zeros(0)
        logs = -n * np.log(1 - values)
        trace = np.cumsum(logs[::-1])[::-1]
        limits = [(critical(k - r, constant), critical(k - r, constant, "eigen")) for r in range(len(values))]
        first = lambda stats, which: next((r for r, x in enumerate(stats) if x <= limits[r][which][at]), k)
        ranks = first(trace, 0), first(logs, 1)
        rows = [(r, values[r], trace[r], *limits[r][0], logs[r], *limits[r][1], *ranks, n) for r in range(len(values))]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    fields = "r int, eigenvalue double, trace double, trace_10 double, trace_5 double, trace_1 double, eigen double, eigen_10 double, eigen_5 double, eigen_1 double, rank_trace int, rank_eigen int, n bigint"
    return _solved(lagged_moments(aligned(panel, names, keys, **columns), keys, lags, columns.get("time", "ts")), keys, fields, solve)


def vecm(panel: DataFrame, names: Sequence, rank: int, keys: Sequence[str] = (), lags: int = 1, constant: int = 0, **columns: str) -> DataFrame:
    """(keys, part, lag, i, j, value): an error correction model with ``rank`` relations.

    part: "beta" (series i in relation j, the first ``rank`` series' block the identity), "alpha" (answer of series i to
    relation j), "gamma" (answer of i to the difference of j ``lag`` times before), "constant" (free constants, j 0),
    "sigma" (covariance of what is left), "log_lik" (i and j 0).
    """
    k = len(names)
    if not 1 <= rank < k:
        raise ValueError("rank must be between 1 and the number of series less one")

    def solve(m: np.ndarray, n: int) -> pd.DataFrame:
        if n <= len(m):
            return pd.DataFrame([], columns=["part", "lag", "i", "j", "value"])
        beta = johansen_solution(m, n, k, lags, constant)[1][:, :rank]
        if np.linalg.matrix_rank(beta[:rank]) == rank:
            beta = beta @ np.linalg.inv(beta[:rank])
        # moments with the relations in place of the levels
        turn = np.zeros((len(m), len(m) - k + rank))
        turn[0, 0] = 1
        turn[1 : k + 1, 1 : k + 1] = np.eye(k)
        turn[k + 1 : 2 * k + 1, k + 1 : k + 1 + rank] = beta
        turn[2 * k + 1 :, k + 1 + rank :] = np.eye(k * lags)
        w = turn.T @ m @ turn
        y, x = list(range(1, k + 1)), [*range(k + 1, len(w)), *([0] if constant == 1 else [])]
        coef = np.linalg.lstsq(w[np.ix_(x, x)], w[np.ix_(x, y)], rcond=None)[0].T
        cross = w[np.ix_(x, y)]
        sigma = (w[np.ix_(y, y)] - coef @ cross - cross.T @ coef.T + coef @ w[np.ix_(x, x)] @ coef.T) / n
        parts = [("beta", 0, beta), ("alpha", 0, coef[:, :rank]), *(("gamma", q + 1, coef[:, rank + q * k : rank + (q + 1) * k]) for q in range(lags))]
        parts += [("constant", 0, coef[:, -1:])] if constant == 1 else []
        parts += [("sigma", 0, sigma), ("log_lik", 0, np.array([[gaussian(sigma, n)]]))]
        return pd.DataFrame([(p, q, i, j, v[i, j]) for p, q, v in parts for i in range(v.shape[0]) for j in range(v.shape[1])], columns=["part", "lag", "i", "j", "value"])

    return _solved(lagged_moments(aligned(panel, names, keys, **columns), keys, lags, columns.get("time", "ts")), keys, "part string, lag int, i int, j int, value double", solve)


def gaussian(sigma: np.ndarray, n: int) -> float:
    sign, size = np.linalg.slogdet(sigma)
    return -0.5 * n * (len(sigma) * np.log(2 * np.pi) + size + len(sigma)) if sign > 0 else -np.inf


def var_solution(m: np.ndarray, n: int, k: int, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constants (k), coefficients (lags, k, k) and residual covariance, divisor n, from moments of levels."""
    y, x = list(range(1, k + 1)), [0, *range(k + 1, len(m))]
    coef = np.linalg.lstsq(m[np.ix_(x, x)], m[np.ix_(x, y)], rcond=None)[0]
    sigma = (m[np.ix_(y, y)] - coef.T @ m[np.ix_(x, y)]) / n
    return coef[0], coef[1:].T.reshape(k, lags, k).transpose(1, 0, 2), (sigma + sigma.T) / 2


def var(panel: DataFrame, names: Sequence, lags: int, horizon: int = 0, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    """(keys, part, lag, i, j, value): a vector autoregression of ``lags`` with constants.

    part: "constant", "coefficient" (of series j ``lag`` times before on i), "sigma", "response" (of i to an orthogonal
    shock of j ``lag`` times before, lags 0 to ``horizon``, Cholesky order as in ``names``), "stationary" (1 or 0),
    "log_lik", "aic", "bic", "hqic" (as totals) and "n". Groups without enough rows give none.
    """
    k = len(names)

    def solve(m: np.ndarray, n: int) -> pd.DataFrame:
        if n <= len(m) - k:
            return pd.DataFrame([], columns=["part", "lag", "i", "j", "value"])
        constant, coef, sigma = var_solution(m, n, k, lags)
        fit, many = gaussian(sigma, n), k * (k * lags + 1)
        companion = np.eye(k * lags, k=-k)
        companion[:k] = np.concatenate(list(coef), axis=1)
        stable = float(np.abs(np.linalg.eigvals(companion)).max() < 1)
        one = lambda v: np.array([[v]])
        parts = [("constant", 0, constant[:, None]), *(("coefficient", q + 1, coef[q]) for q in range(lags)), ("sigma", 0, sigma), ("stationary", 0, one(stable)), ("n", 0, one(n))]
        parts += [("log_lik", 0, one(fit)), ("aic", 0, one(2 * many - 2 * fit)), ("bic", 0, one(many * np.log(n) - 2 * fit)), ("hqic", 0, one(2 * many * np.log(np.log(n)) - 2 * fit))]
        power, shock = np.eye(k * lags), np.linalg.cholesky(sigma)
        for h in range(horizon + 1 if horizon else 0):
            parts.append(("response", h, power[:k, :k] @ shock))
            power = companion @ power
        return pd.DataFrame([(p, q, i, j, float(v[i, j])) for p, q, v in parts for i in range(v.shape[0]) for j in range(v.shape[1])], columns=["part", "lag", "i", "j", "value"])

    return _solved(lagged_moments(aligned(panel, names, keys, **columns), keys, lags, columns.get("time", "ts"), levels=True), keys, "part string, lag int, i int, j int, value double", solve)


def forecast(panel: DataFrame, names: Sequence, lags: int, horizon: int, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    """(keys, step, i, value): ``var`` carried on from the last rows, steps 1 to ``horizon``."""
    k, time = len(names), columns.get("time", "ts")
    rows = aligned(panel, names, keys, **columns)
    newest = Window.partitionBy(*keys).orderBy(c(time).desc())
    rows = rows.withColumn("_age", F.row_number().over(newest)).filter(c("_age") <= lags)
    last = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_age", "y"))), lambda e: e["y"]).alias("past"))
    fitted = var(panel, names, lags, keys=keys, **columns).filter(c("part").isin("constant", "coefficient"))
    fitted = fitted.groupBy(*keys).agg(F.collect_list(F.struct("part", "lag", "i", "j", "value")).alias("m"))
    both = join_on(fitted, last, list(keys))

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                step = np.zeros((lags + 1, k, k))
                for e in row.m:
                    step[e["lag"], e["i"], e["j"]] = e["value"]
                past, out = [np.array(v, float) for v in row.past], []
                for h in range(1, horizon + 1):
                    now = step[0][:, 0] + sum(step[q + 1] @ past[q] for q in range(lags))
                    past = [now, *past[: lags - 1]]
                    out += [(*row[: len(keys)], h, i, float(now[i])) for i in range(k)]
                yield pd.DataFrame(out, columns=[*keys, "step", "i", "value"])

    heads = "".join(f"`{x}` {panel.schema[x].dataType.simpleString()}, " for x in keys)
    return both.select(*keys, "m", "past").mapInPandas(run, heads + "step int, i int, value double")

