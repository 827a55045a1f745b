"""Linear Gaussian state space models of many series, long ones included: filter, likelihood, smoother.

A recursion over time is a prefix scan. What a row does to the state (its filtering element) composes
associatively, and so does what the smoother does backwards. A series is cut into blocks: every block
composes its elements, the blocks' compositions are carried along each series, and every block then filters
from its own start. The backward pass goes the same way. So one long series is many tasks' work; only one
element a block meets the others. Within a task all blocks of a read go through NumPy in step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import cut_lineage, in_order, join_on, whole_blocks
from ..functions.windows import Series

#: Rows of a block and, about, of a step that takes blocks together.
BLOCK_ROWS, STEP_ROWS = 512, 65_536
#: Blocks up to which their carried states are broadcast; beyond, they meet the rows in a shuffle join.
BROADCAST_BLOCKS = 100_000


@dataclass(frozen=True)
class Model:
    """x_t = step x_(t-1) + noise of covariance ``drift``; z_t = seen x_t + noise of covariance ``error``.
    The state before the first row has mean ``start`` and covariance ``spread``. seen drift seen' + error must be regular."""

    step: np.ndarray
    seen: np.ndarray
    drift: np.ndarray
    error: np.ndarray
    start: np.ndarray
    spread: np.ndarray

    def __post_init__(self) -> None:
        for name in ("step", "seen", "drift", "error", "spread"):
            object.__setattr__(self, name, np.atleast_2d(np.asarray(getattr(self, name), float)))
        object.__setattr__(self, "start", np.atleast_1d(np.asarray(self.start, float)))
        n, m = len(self.step), len(self.seen)
        shapes = {"step": (n, n), "seen": (m, n), "drift": (n, n), "error": (m, m), "spread": (n, n), "start": (n,)}
        for name, shape in shapes.items():
            if getattr(self, name).shape != shape:
                raise ValueError(f"{name} must have the shape {shape}")
        if np.linalg.eigvalsh(self.innovation).min() <= 0:
            raise ValueError("seen drift seen' + error must be positive definite")

    @property
    def innovation(self) -> np.ndarray:
        return self.seen @ self.drift @ self.seen.T + self.error


def local_level(drift: float, error: float, start: float = 0.0, spread: float = 1e6) -> Model:
    """A random walk seen with noise."""
    return Model([[1.0]], [[1.0]], [[drift]], [[error]], [start], [[spread]])


def local_trend(level: float, slope: float, error: float, spread: float = 1e6) -> Model:
    """A level with a slope, both random walks, the level seen with noise."""
    return Model([[1.0, 1.0], [0.0, 1.0]], [[1.0, 0.0]], np.diag([level, slope]), [[error]], np.zeros(2), spread * np.eye(2))


def arma(ar: Sequence[float], ma: Sequence[float], sigma2: float) -> Model:
    """ARMA in companion form of max(p, q + 1) states, from its stationary distribution."""
    if sigma2 <= 0 or not len(ar) + len(ma):
        raise ValueError("sigma2 must be positive and there must be a coefficient")
    n = max(len(ar), len(ma) + 1)
    step = np.eye(n, k=1)
    step[: len(ar), 0] = ar
    if np.abs(np.linalg.eigvals(step)).max() >= 1:
        raise ValueError("the autoregression is not stationary")
    shock = np.zeros((n, 1))
    shock[: len(ma) + 1, 0] = [1.0, *ma]
    drift = sigma2 * shock @ shock.T
    spread = np.linalg.solve(np.eye(n * n) - np.kron(step, step), drift.ravel()).reshape(n, n)
    return Model(step, np.eye(1, n), drift, [[0.0]], np.zeros(n), (spread + spread.T) / 2)


# Elements: (A, b, C, e, J) of p(x_t | x_(t-1), z_t) = N(A x + b, C) and p(z_t | x_(t-1)) in information form


def _t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _mv(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x[..., None])[..., 0]


def elements(model: Model, z: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements of rows z (k, m); kind: 0 seen, 1 missing, 2 no row (changes nothing)."""
    n = len(model.step)
    gain = np.linalg.solve(model.innovation, model.seen @ model.drift).T
    rest, eye, zero = np.eye(n) - gain @ model.seen, np.eye(n), np.zeros((n, n))
    back = model.step.T @ model.seen.T @ np.linalg.inv(model.innovation)
    a = np.stack([rest @ model.step, model.step, eye])[kind]
    cov = np.stack([rest @ model.drift, model.drift, zero])[kind]
    j = np.stack([back @ model.seen @ model.step, zero, zero])[kind]
    known = np.where((kind == 0)[:, None], z, 0.0)
    return a, known @ gain.T, (cov + _t(cov)) / 2, known @ back.T, (j + _t(j)) / 2


def compose(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """First ``one``, then ``two``; all arrays may have leading dimensions."""
    a1, b1, c1, e1, j1 = one
    a2, b2, c2, e2, j2 = two
    d = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
    left, right = a2 @ d, _t(a1) @ _t(d)
    c, j = left @ c1 @ _t(a2) + c2, right @ j2 @ a1 + j1
    return left @ a1, _mv(left, b1 + _mv(c1, e2)) + b2, (c + _t(c)) / 2, _mv(right, e2 - _mv(j2, b1)) + e1, (j + _t(j)) / 2


def _blocks(model: Model, z: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compositions of blocks z (k, length, m)."""
    whole = elements(model, z[:, 0], kind[:, 0])
    for i in range(1, z.shape[1]):
        whole = compose(whole, elements(model, z[:, i], kind[:, i]))
    return whole


def _filter(model: Model, z: np.ndarray, kind: np.ndarray, x: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """The filter over blocks z (k, length, m) from states x (k, n) and covariances p."""
    k, length, m = z.shape
    n, eye = x.shape[1], np.eye(x.shape[1])
    out = {"x": np.zeros((k, length, n)), "p": np.zeros((k, length, n, n)), "gap": np.full((k, length, m), np.nan), "ll": np.full((k, length), np.nan)}
    for i in range(length):
        there, seen = (kind[:, i] < 2), (kind[:, i] == 0)
        ahead = model.step @ p @ model.step.T + model.drift
        x = np.where(there[:, None], x @ model.step.T, x)
        p = np.where(there[:, None, None], (ahead + _t(ahead)) / 2, p)
        s = np.where(there[:, None, None], model.seen @ p @ model.seen.T + model.error, np.eye(m))
        gain = _t(np.linalg.solve(s, model.seen @ p))
        gap = z[:, i] - x @ model.seen.T
        out["gap"][:, i] = np.where(seen[:, None], gap, np.nan)
        fit = (gap * np.linalg.solve(s, gap[..., None])[..., 0]).sum(-1)
        out["ll"][:, i] = np.where(seen, -0.5 * (m * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + fit), np.nan)
        rest = eye - gain @ model.seen
        x = np.where(seen[:, None], x + _mv(gain, np.where(seen[:, None], gap, 0.0)), x)
        p = np.where(seen[:, None, None], rest @ p @ _t(rest) + gain @ model.error @ _t(gain), p)
        p = (p + _t(p)) / 2
        out["x"][:, i], out["p"][:, i] = x, p
    return out


def _back(model: Model, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(E, g, L): the smoothed state is E next + g, its covariance E next E' + L."""
    ahead = model.step @ p @ model.step.T + model.drift
    e = _t(np.linalg.pinv(ahead, rcond=1e-10, hermitian=True) @ model.step @ p)
    rest = p - e @ ahead @ _t(e)
    return e, x - _mv(e, x @ model.step.T), (rest + _t(rest)) / 2


def _padded(frame: pd.DataFrame, at: np.ndarray, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """z (k, length, m), kind, and the rows' block and place."""
    sizes = np.diff(np.append(at, len(frame)))
    block = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(len(frame)) - np.repeat(at, sizes)
    data = frame[values].to_numpy(float, na_value=np.nan)
    z = np.zeros((len(at), sizes.max(), len(values)))
    kind = np.full(z.shape[:2], 2)
    missing = ~np.isfinite(data).all(axis=1)
    z[block, place] = np.where(missing[:, None], 0.0, data)
    kind[block, place] = missing.astype(int)
    return z, kind, block, place


def smooth(df: DataFrame, value: str | Sequence[str], model: Model, s: Series) -> DataFrame:
    """Adds filtered, filtered_var, innovation, log_lik, smoothed and smoothed_var to the rows.

    filtered and smoothed are arrays, one entry a state, with the variances beside them; innovation has one entry a
    value and is null, like log_lik, where any of the row's values is null or not finite: such a row is a missing
    observation that only moves the state on. Columns of ``df`` with these names are replaced. The order must be
    unique within a series.
    """
    values = [value] if isinstance(value, str) else list(value)
    if len(values) != len(model.seen):
        raise ValueError(f"the model sees {len(model.seen)} values, not {len(values)}")
    made = ("filtered", "filtered_var", "innovation", "log_lik", "smoothed", "smoothed_var")
    keys, n, shift = list(s.keys), len(model.step), BLOCK_ROWS.bit_length() - 1
    keep = [x for x in df.columns if x not in made]
    rows = in_order(df.select(*keep), [*keys, *s.order]).withColumn("_block", F.shiftright("_id", shift))
    heads = [*keys, "_block"]
    key_fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    numbers = F.array(*(F.col(f"`{v}`").cast("double") for v in values))
    slim = rows.select(*keys, "_block", *(F.get(numbers, i).alias(f"_z{i}") for i in range(len(values))))
    z_names = [f"_z{i}" for i in range(len(values))]

    def frame_of(part: pd.DataFrame, at: np.ndarray, arrays: dict[str, np.ndarray]) -> pd.DataFrame:
        out = part.iloc[at][heads].reset_index(drop=True)
        for name, a in arrays.items():
            out[name] = list(a.reshape(len(at), -1))
        return out

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, at in whole_blocks(frames, heads, STEP_ROWS):
            z, kind, _, _ = _padded(part, at, z_names)
            yield frame_of(part, at, dict(zip("abcej", _blocks(model, z, kind), strict=True)))

    def carry(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block").reset_index(drop=True)
        x, p, xs, ps = model.start, model.spread, [], []
        for a, b, cov, e, j in zip(*(part[q] for q in "abcej"), strict=True):
            xs.append(x)
            ps.append(p.ravel())
            a, cov, j = (q.reshape(n, n) for q in (a, cov, j))
            left = a @ np.linalg.inv(np.eye(n) + p @ j)
            x, p = left @ (x + p @ e) + b, left @ p @ a.T + cov
            p = (p + p.T) / 2
        out = part[heads].copy()
        out["_x"], out["_p"], out["_last"] = xs, ps, part.index == len(part) - 1
        return out

    arrays = ", ".join(f"{q} array<double>" for q in "abcej")
    summed = slim.mapInPandas(forward, f"{key_fields}_block bigint, {arrays}")
    start = cut_lineage(summed.groupBy(*keys).applyInPandas(carry, f"{key_fields}_block bigint, _x array<double>, _p array<double>, _last boolean"))
    small = start.count() <= BROADCAST_BLOCKS

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        if small:
            return join_on(left, F.broadcast(right), heads)
        return join_on(left, right, heads).sortWithinPartitions(*heads, *(["_id"] if "_id" in left.columns else []))

    def states(part: pd.DataFrame, at: np.ndarray, x: str, p: str) -> tuple[np.ndarray, np.ndarray]:
        return np.stack(part[x].iloc[at].to_list()), np.stack(part[p].iloc[at].to_list()).reshape(len(at), n, n)

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, at in whole_blocks(frames, heads, STEP_ROWS):
            z, kind, _, _ = _padded(part, at, z_names)
            f = _filter(model, z, kind, *states(part, at, "_x", "_p"))
            whole = np.tile(np.eye(n), (len(at), 1, 1)), np.zeros((len(at), n)), np.zeros((len(at), n, n))
            final = part["_last"].iloc[at].to_numpy(bool)
            size = (kind < 2).sum(axis=1)
            for i in range(z.shape[1]):
                e, g, rest = _back(model, f["x"][:, i], f["p"][:, i])
                end = (final & (size == i + 1))[:, None]
                e, g, rest = np.where(end[..., None], 0.0, e), np.where(end, f["x"][:, i], g), np.where(end[..., None], f["p"][:, i], rest)
                there = (kind[:, i] < 2)[:, None]
                made_ = whole[0] @ e, _mv(whole[0], g) + whole[1], whole[0] @ rest @ _t(whole[0]) + whole[2]
                whole = tuple(np.where(there[..., None] if q.ndim == 3 else there, new, q) for q, new in zip(whole, made_, strict=True))
            yield frame_of(part, at, dict(zip("egl", whole, strict=True)))

    def carry_back(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block", ascending=False).reset_index(drop=True)
        x, p, xs, ps = np.zeros(n), np.zeros((n, n)), [], []
        for e, g, rest in zip(*(part[q] for q in "egl"), strict=True):
            xs.append(x)
            ps.append(p.ravel())
            e = e.reshape(n, n)
            x, p = e @ x + g, e @ p @ e.T + rest.reshape(n, n)
        out = part[heads].copy()
        out["_nx"], out["_np"] = xs, ps
        return out

    back = met(rows.select(*keys, "_block", "_id", *(F.get(numbers, i).alias(f"_z{i}") for i in range(len(values)))), start).mapInPandas(backward, f"{key_fields}_block bigint, e array<double>, g array<double>, l array<double>")
    ends = back.groupBy(*keys).applyInPandas(carry_back, f"{key_fields}_block bigint, _nx array<double>, _np array<double>")
    both = cut_lineage(join_on(start, ends, heads))

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, at in whole_blocks(frames, heads, STEP_ROWS):
            z, kind, block, place = _padded(part, at, z_names)
            f = _filter(model, z, kind, *states(part, at, "_x", "_p"))
            xs, ps = np.zeros_like(f["x"]), np.zeros_like(f["p"])
            x, p = states(part, at, "_nx", "_np")
            end, size = part["_last"].iloc[at].to_numpy(bool), (kind < 2).sum(axis=1)
            for i in range(z.shape[1] - 1, -1, -1):
                e, g, rest = _back(model, f["x"][:, i], f["p"][:, i])
                tip, there = (end & (size == i + 1))[:, None], (kind[:, i] < 2)[:, None]
                new, wide = _mv(e, x) + g, e @ p @ _t(e) + rest
                new, wide = np.where(tip, f["x"][:, i], new), np.where(tip[..., None], f["p"][:, i], wide)
                x, p = np.where(there, new, x), np.where(there[..., None], (wide + _t(wide)) / 2, p)
                xs[:, i], ps[:, i] = x, p
            out = part[keep].reset_index(drop=True)
            pick = lambda a: list(a[block, place])
            variances = lambda a: list(np.diagonal(a[block, place], axis1=-2, axis2=-1))
            seen = kind[block, place] == 0
            out["filtered"], out["filtered_var"] = pick(f["x"]), variances(f["p"])
            out["innovation"] = [v if ok else None for v, ok in zip(f["gap"][block, place], seen, strict=True)]
            out["log_lik"] = pd.array(np.where(seen, f["ll"][block, place], 0.0), dtype="Float64")
            out.loc[~seen, "log_lik"] = pd.NA
            out["smoothed"], out["smoothed_var"] = pick(xs), variances(ps)
            yield out

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep)
    wide = rows.withColumns({f"_z{i}": F.get(numbers, i) for i in range(len(values))})
    return met(wide, both).mapInPandas(final, fields + ", " + ", ".join(f"{x} {'double' if x == 'log_lik' else 'array<double>'}" for x in made))


def log_likelihood(smoothed: DataFrame, s: Series) -> DataFrame:
    """(keys, log_likelihood, n_seen) of rows from ``smooth``."""
    return smoothed.groupBy(*s.keys).agg(F.sum("log_lik").alias("log_likelihood"), F.count("log_lik").alias("n_seen"))
