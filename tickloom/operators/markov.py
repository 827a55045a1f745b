"""Markov chains by aggregation; hidden Markov models and Ornstein-Uhlenbeck fits per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hmm
from ..functions.ordering import whole_blocks
from ..functions.windows import Series, ratio

c = F.col


def transition_counts(states: DataFrame, s: Series, state: str = "state", order: int = 1) -> DataFrame:
    """(context, state, n, p): transitions over all series; context holds the ``order`` states before."""
    before = [s.lag(state, k) for k in range(order, 0, -1)]
    rows = states.select(F.array(*before).alias("context"), c(state).alias("state"), before[0].isNotNull().alias("_ok")).filter("_ok")
    counts = rows.groupBy("context", "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", c("n") / F.sum("n").over(Window.partitionBy("context")))


def transition_matrix(states: DataFrame, s: Series, names: Sequence[str], state: str = "state") -> np.ndarray:
    """Dense matrix over the named states; rows of states never left are even."""
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in transition_counts(states, s, state).collect():  # states squared
        out[place[r["context"][0]], place[r["state"]]] = r["n"]
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 0, out / np.maximum(total, 1), 1 / len(names))


def stationary(matrix: np.ndarray) -> np.ndarray:
    """The distribution that the chain keeps."""
    n = len(matrix)
    system = np.vstack([matrix.T - np.eye(n), np.ones(n)])
    return np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0]


def n_step(matrix: np.ndarray, n: int) -> np.ndarray:
    if n < 0:
        raise ValueError("n must not be negative")
    return np.linalg.matrix_power(matrix, n)


def first_order(matrix: dict[tuple, dict], states: Sequence) -> tuple[list[tuple], np.ndarray]:
    """A chain of higher order as one of first order over contexts."""
    contexts = sorted(matrix)
    place = {k: i for i, k in enumerate(contexts)}
    out = np.zeros((len(contexts), len(contexts)))
    for k, row in matrix.items():
        for state, p in row.items():
            if (after := (*k[1:], state)) in place:
                out[place[k], place[after]] = p
    return contexts, out


def simulate(matrix: np.ndarray, start: int, steps: int, seed: int = 0) -> np.ndarray:
    draws, sums, out = np.random.default_rng(seed).random(steps), np.cumsum(matrix, axis=1), [start]
    for u in draws:
        out.append(int(min(np.searchsorted(sums[out[-1]], u, side="right"), len(matrix) - 1)))
    return np.array(out)


def log_likelihood(states: DataFrame, counts: DataFrame, s: Series, state: str = "state") -> DataFrame:
    """(keys, log_likelihood, n) of each series under first-order transitions, floored at 1e-12."""
    rows = states.withColumn("_from", s.lag(state)).filter("_from is not null")
    p = counts.select(c("context")[0].alias("_from"), c("state").alias(state), "p")
    joined = rows.join(p, ["_from", state], "left")
    return joined.groupBy(*s.keys).agg(F.sum(F.ln(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12)))).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))


def gaussian_hmm(df: DataFrame, features: Sequence[str], n_states: int, s: Series, restarts: int = 5, steps: int = 200) -> DataFrame:
    """Adds state: the likeliest path of a Gaussian model fitted to each series, states in order of their first mean."""

    def run(*columns):
        x = np.stack(columns, axis=1)
        good = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if good.sum() > 5 * n_states:
            m = hmm.fit_gaussian(x[good], n_states, restarts, steps)
            path = hmm.viterbi(hmm.gaussian_emissions(x[good], m["means"], m["covs"]), np.log(m["step"] + 1e-12), np.log(m["start"] + 1e-12))
            out[good] = np.argsort(np.argsort(m["means"][:, 0]))[path]
        return {"state": out}

    return s.kernel(df, list(features), {"state": "bigint"}, run)


def ou_fit(df: DataFrame, value: str, s: Series, dt: float = 1.0) -> DataFrame:
    """(keys, theta, mu, sigma, half_life, stationary_std, n): exact discretisation by regression on the value before."""
    rows = df.withColumn("_x", s.lag(value)).filter("_x is not null")
    out = rows.groupBy(*s.keys).agg(F.regr_slope(value, "_x").alias("b"), F.regr_intercept(value, "_x").alias("a"), F.regr_syy(value, "_x").alias("_yy"), F.regr_sxy(value, "_x").alias("_xy"), F.count(F.lit(1)).alias("n"))
    mean_reverting = (c("b") > 0) & (c("b") < 1)
    theta = F.when(mean_reverting, -F.ln(F.when(mean_reverting, c("b"))) / dt)
    noise = (c("_yy") - c("b") * c("_xy")) / c("n")
    out = out.withColumns({"theta": theta, "mu": ratio(c("a"), 1 - c("b")), "_v": noise})
    out = out.withColumn("sigma", F.sqrt(c("_v") * 2 * c("theta") / (1 - c("b") ** 2)))
    return out.select(*s.keys, "theta", "mu", "sigma", (F.ln(F.lit(2.0)) / c("theta")).alias("half_life"), (c("sigma") / F.sqrt(2 * c("theta"))).alias("stationary_std"), "n")


def hedge_ratio(df: DataFrame, y: str, x: str, keys: Sequence[str]) -> DataFrame:
    """(keys, ols, tls): slopes by least squares and by the principal direction."""
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("ols"), F.var_samp(y).alias("_yy"), F.var_samp(x).alias("_xx"), F.covar_samp(y, x).alias("_xy"))
    tls = (c("_yy") - c("_xx") + F.sqrt((c("_yy") - c("_xx")) ** 2 + 4 * c("_xy") ** 2)) / F.nullif(2 * c("_xy"), F.lit(0.0))
    return out.select(*keys, "ols", tls.alias("tls"))


def half_life(df: DataFrame, value: str, s: Series) -> DataFrame:
    """(keys, half_life): of the pull back to the mean; infinite without one."""
    rows = df.withColumns({"_x": s.lag(value), "_d": c(value) - s.lag(value)}).filter("_x is not null")
    out = rows.groupBy(*s.keys).agg(F.regr_slope("_d", "_x").alias("b"))
    return out.select(*s.keys, F.when(c("b") < 0, -F.ln(F.lit(2.0)) / F.when(c("b") < 0, c("b"))).otherwise(F.lit(float("inf"))).alias("half_life"))


def symbols(df: DataFrame, state: str) -> DataFrame:
    """(state, symbol): the different states numbered from 0 in their order; null has no number."""
    return df.select(state).distinct().filter(c(state).isNotNull()).withColumn("symbol", (F.row_number().over(Window.orderBy(state)) - 1).cast("int"))


def discrete_hmm(df: DataFrame, symbol: str, n_states: int, n_symbols: int, keys: Sequence[str], order: str | Sequence[str], restarts: int = 5, steps: int = 200) -> DataFrame:
    """(keys, log_likelihood, path): Baum-Welch fit and Viterbi path of each series of symbols 0..n-1; series of a task are fitted side by side."""
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, at in whole_blocks(frames, keys):
            obs = np.split(frame[symbol].to_numpy(int), at[1:])
            fits = hmm.fit_discrete_many(obs, n_states, n_symbols, restarts, steps)
            paths = hmm.viterbi_discrete_many(obs, fits)
            yield frame[keys].iloc[at].reset_index(drop=True).assign(log_likelihood=[f["log_likelihood"] for f in fits], path=[p.tolist() for p in paths])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*dict.fromkeys([*keys, *order, symbol])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInPandas(run, f"{fields}, log_likelihood double, path array<bigint>")


def ou_simulate(theta: float, mu: float, sigma: float, start: float, steps: int, dt: float = 1.0, seed: int = 0) -> np.ndarray:
    """A path by the exact transition law."""
    keep = np.exp(-theta * dt)
    noise = sigma * np.sqrt((1 - keep**2) / (2 * theta)) * np.random.default_rng(seed).normal(size=steps)
    out = [start]
    for e in noise:
        out.append(mu + keep * (out[-1] - mu) + e)
    return np.array(out)


def ou_log_likelihood(x: np.ndarray, theta: float, mu: float, sigma: float, dt: float = 1.0) -> float:
    keep = np.exp(-theta * dt)
    v = sigma**2 * (1 - keep**2) / (2 * theta)
    gap = x[1:] - mu - keep * (x[:-1] - mu)
    return float(-0.5 * (np.log(2 * np.pi * v) + gap**2 / v).sum())


def simulate_hmm(step: np.ndarray, emit: np.ndarray, start: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """States and symbols of a discrete model."""
    rng, states = np.random.default_rng(seed), []
    for t in range(n):
        states.append(int(rng.choice(len(start), p=start if t == 0 else step[states[-1]])))
    return np.array(states), np.array([int(rng.choice(emit.shape[1], p=emit[s])) for s in states])


def simulate_tensor(tensor: dict[tuple, dict], context: tuple, steps: int, seed: int = 0) -> list:
    """A path of a chain of higher order; it ends early at a context that was never seen."""
    rng, out = np.random.default_rng(seed), list(context)
    for _ in range(steps):
        row = tensor.get(tuple(out[-len(context) :]))
        if not row:
            break
        names = sorted(row)
        p = np.array([row[n] for n in names], float)
        out.append(names[int(rng.choice(len(names), p=p / p.sum()))])
    return out
