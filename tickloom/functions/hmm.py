"""Hidden Markov models in log space: discrete and Gaussian emissions."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.empty_like(emit)
    out[0] = start + emit[0]
    for t in range(1, len(emit)):
        out[t] = _lse(out[t - 1][:, None] + step, 0) + emit[t]
    return out


def backward(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = np.zeros_like(emit)
    for t in range(len(emit) - 2, -1, -1):
        out[t] = _lse(step + (emit[t + 1] + out[t + 1])[None], 1)
    return out


def posteriors(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities, expected transitions, log-likelihood."""
    a, b = forward(emit, step, start), backward(emit, step)
    total = float(_lse(a[-1], 0))
    gamma = np.exp(a + b - total)
    xi = np.exp(a[:-1, :, None] + step[None] + (emit[1:] + b[1:])[:, None, :] - total)
    return gamma, xi.sum(axis=0), total


def viterbi(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    score, back = start + emit[0], []
    for t in range(1, len(emit)):
        reach = score[:, None] + step
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0) + emit[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12))


def fit_discrete(obs: np.ndarray, k: int, symbols: int, restarts: int = 3, steps: int = 100, tolerance: float = 1e-6, seed: int = 0) -> dict:
    """Baum-Welch from several random starts, side by side."""
    return fit_discrete_many([obs], k, symbols, restarts, steps, tolerance, seed)[0]


def side_by_side(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of series that run side by side: the longest first, none under half of its group's longest, so that at most half is padding."""
    at, out = np.argsort(-sizes, kind="stable"), []
    while len(at):
        n = int(np.searchsorted(-2 * sizes[at], -sizes[at[0]], "right"))
        out.append(at[:n])
        at = at[n:]
    return out


def _padded(obs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, series) of series that fall in length, and how many are still there at each time."""
    sizes = np.array([len(x) for x in obs])
    out = np.zeros((sizes[0], len(obs)), "int64")
    for i, x in enumerate(obs):
        out[: len(x), i] = x
    return out, np.searchsorted(-sizes, -np.arange(sizes[0]), "left")


def _expected(seen: np.ndarray, there: np.ndarray, p: np.ndarray, q: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First state, expected steps, expected symbols by state and log likelihood of models side by side; the last axis is the model. Each time is scaled to one."""
    n, k, m = len(seen), len(p), p.shape[1]
    flat = seen * m + np.arange(m)
    emit = np.stack([x.ravel()[flat] for x in o], axis=1)
    front, scale = np.zeros((n, k, m)), np.ones((n, m))
    for t, w in enumerate(there.tolist()):
        if t:
            now = front[t - 1, 0, :w] * q[0, :, :w]
            for i in range(1, k):
                now += front[t - 1, i, :w] * q[i, :, :w]
            now *= emit[t, :, :w]
        else:
            now = p * emit[0]
        scale[t, :w] = now.sum(axis=0)
        np.divide(now, scale[t, :w], out=front[t, :, :w])
    back, xi = np.ones((k, m)), np.zeros((k, k, m))
    for t in range(n - 2, -1, -1):
        w = int(there[t + 1])
        ahead = emit[t + 1, :, :w] * back[:, :w]
        ahead /= scale[t + 1, :w]
        for i in range(k):
            xi[i, :, :w] += front[t, i, :w] * ahead
        now = q[:, 0, :w] * ahead[0]
        for j in range(1, k):
            now += q[:, j, :w] * ahead[j]
        back[:, :w] = now
        front[t] *= back
    mass = np.stack([np.bincount(flat.ravel(), front[:, i].ravel(), o.shape[1] * m).reshape(-1, m) for i in range(k)])
    return front[0] / front[0].sum(axis=0), xi * q, mass, np.log(scale).sum(axis=0)


def fit_discrete_many(obs: list[np.ndarray], k: int, symbols: int, restarts: int = 3, steps: int = 100, tolerance: float = 1e-6, seed: int = 0) -> list[dict]:
    """Baum-Welch of each of many series from the same random starts; all series and starts of about one length run side by side, each until it stands still."""
    rng, fits = np.random.default_rng(seed), [{} for _ in obs]
    draws = [(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k)) for _ in range(restarts)]
    firsts = [np.stack(x, axis=-1) for x in zip(*draws, strict=True)]
    for group in side_by_side(np.array([len(x) for x in obs])):
        seen, there = _padded([obs[i] for i in group])
        pi, a, e = (np.tile(x, len(group)) for x in firsts)
        own, total, live = np.repeat(np.arange(len(group)), restarts), np.full(len(group) * restarts, -np.inf), np.arange(len(group) * restarts)
        for _ in range(steps):
            sizes = np.searchsorted(own[live], np.concatenate([there, [0]]), "left")[:-1]
            first, xi, mass, now = _expected(seen[: int((sizes > 0).sum()), own[live]], sizes[sizes > 0], *(np.maximum(x[..., live], 1e-12) for x in (pi, a, e)))
            pi[:, live], a[..., live] = first, xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-12)
            e[..., live] = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-12)
            on = now - total[live] >= tolerance
            total[live] = now
            live = live[on]
            if not len(live):
                break
        best = total.reshape(-1, restarts).argmax(axis=1) + restarts * np.arange(len(group))
        for i, r in zip(group.tolist(), best.tolist(), strict=True):
            fits[i] = {"start": pi[:, r], "step": a[..., r], "emit": e[..., r], "log_likelihood": float(total[r])}
    return fits


def viterbi_discrete_many(obs: list[np.ndarray], fits: list[dict]) -> list[np.ndarray]:
    """The likeliest path of each series under its own model."""
    paths: list[np.ndarray] = [np.zeros(0, "int64") for _ in obs]
    for group in side_by_side(np.array([len(x) for x in obs])):
        seen, there = _padded([obs[i] for i in group])
        start, step, out = (np.log(np.stack([fits[i][x] for i in group], axis=-1) + 1e-12) for x in ("start", "step", "emit"))
        m = len(group)
        score, back, at = start + out[:, seen[0], np.arange(m)], np.zeros((len(seen), len(start), m), "int8" if len(start) < 128 else "int64"), np.arange(m)
        for t, w in enumerate(there.tolist()):
            if t:
                reach = score[:, None, :w] + step[:, :, :w]
                back[t, :, :w] = reach.argmax(axis=0)
                score[:, :w] = reach.max(axis=0) + out[:, seen[t, :w], at[:w]]
        state, path = score.argmax(axis=0), np.zeros(seen.shape, "int64")
        for t in range(len(seen) - 1, -1, -1):
            w = int(there[t])
            path[t, :w] = state[:w]
            if t:
                state[:w] = back[t, state[:w], at[:w]]
        for j, i in enumerate(group.tolist()):
            paths[i] = path[: len(obs[i]), j]
    return paths


def gaussian_emissions(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for s, (m, c) in enumerate(zip(means, covs, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, s] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _smoothed(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State shares, expected steps and log likelihood of several models at once; emit (model, time, state) in logs. Each time is scaled to one."""
    top = emit.max(axis=2, keepdims=True)
    b = np.exp(emit - top)
    models, n, k = b.shape
    front, back, scale = np.empty_like(b), np.ones_like(b), np.empty((models, n))
    now = start * b[:, 0]
    for t in range(n):
        if t:
            now = np.einsum("mi,mij->mj", front[:, t - 1], step) * b[:, t]
        scale[:, t] = np.maximum(now.sum(axis=1), 1e-300)
        front[:, t] = now / scale[:, t, None]
    for t in range(n - 2, -1, -1):
        back[:, t] = np.einsum("mij,mj->mi", step, b[:, t + 1] * back[:, t + 1]) / scale[:, t + 1, None]
    xi = np.einsum("mti,mtj->mij", front[:, :-1], b[:, 1:] * back[:, 1:] / scale[:, 1:, None]) * step
    return front * back, xi, np.log(scale).sum(axis=1) + top.sum(axis=(1, 2))


def fit_gaussian(x: np.ndarray, k: int, restarts: int = 3, steps: int = 100, tolerance: float = 1e-6, seed: int = 0) -> dict:
    """EM with full covariances; a ridge keeps them regular. All starts run side by side, each until it stands still."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    means = np.stack([x[rng.choice(len(x), k, replace=False)] for _ in range(restarts)])
    covs = np.tile(np.cov(x.T).reshape(d, d) + 1e-3 * np.eye(d), (restarts, k, 1, 1))
    pi, a, total = np.full((restarts, k), 1 / k), np.full((restarts, k, k), 1 / k), np.full(restarts, -np.inf)
    live = np.arange(restarts)
    for _ in range(steps):
        emit = np.stack([gaussian_emissions(x, means[m], covs[m]) for m in live])
        gamma, xi, now = _smoothed(emit, a[live], pi[live])
        pi[live] = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True)
        a[live] = xi / np.maximum(xi.sum(axis=2, keepdims=True), 1e-12)
        mass = np.maximum(gamma.sum(axis=1), 1e-12)
        means[live] = np.einsum("mtk,td->mkd", gamma, x) / mass[..., None]
        for m, shares in zip(live, gamma, strict=True):
            for s in range(k):
                gap = x - means[m, s]
                covs[m, s] = (shares[:, s, None] * gap).T @ gap / max(shares[:, s].sum(), 1e-12) + 1e-4 * np.eye(d)
        moved = now - total[live] >= tolerance
        total[live] = now
        live = live[moved]
        if not len(live):
            break
    best = int(np.argmax(total))
    return {"start": pi[best], "step": a[best], "means": means[best], "covs": covs[best], "log_likelihood": float(total[best])}
