"""k-means and Gaussian mixtures in numpy; the number of clusters given or chosen.

A fit is a generator: it asks for sums over its rows and is sent them, so that the same code runs over rows in memory and over blocks of rows that a
cluster holds. Rows are different vectors with the number of times that each occurs. Fits that don't wait for each other ask together.
"""

from __future__ import annotations

import json
from collections.abc import Generator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

FLOOR = 1e-6

#: Yields lists of (kind, ...), is sent for each what ANSWERS gives for all rows.
Steps = Generator[list[tuple], list[tuple], Any]


@dataclass
class Fit:
    labels: np.ndarray
    centers: np.ndarray
    probability: np.ndarray | None = None
    bic: float = float("nan")
    diagnostics: list[dict] = field(default_factory=list)


@dataclass
class Model:
    """Centers, for mixtures with what turns rows into log densities: inverse Cholesky factors and constants."""

    centers: np.ndarray
    sizes: np.ndarray
    inverse: np.ndarray | None = None
    constant: np.ndarray | None = None
    bic: float = float("nan")
    diagnostics: list[dict] = field(default_factory=list)


class Rows:
    """A block of vectors, each w times."""

    def __init__(self, x: np.ndarray, w: np.ndarray | None = None, block: int = 0):
        self.x, self.w, self.block = x, np.ones(len(x)) if w is None else w, block
        self.squares = (x * x).sum(1)
        self._scaled: tuple[np.ndarray, np.ndarray, Rows] | None = None

    def scaled(self, mean: np.ndarray, dev: np.ndarray) -> Rows:
        if self._scaled is None or not (np.array_equal(self._scaled[0], mean) and np.array_equal(self._scaled[1], dev)):
            self._scaled = (mean, dev, Rows((self.x - mean) / dev, self.w, self.block))
        return self._scaled[2]

    def distances(self, c: np.ndarray) -> np.ndarray:
        return np.maximum(0, self.squares[:, None] - 2 * self.x @ c.T + (c * c).sum(1)[None])


def deviations(var: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Roots of variances; zero and odd ones are 1, sine and cosine share one."""
    for a, b in pairs:
        var[a] = var[b] = (var[a] + var[b]) / 2
    dev = np.sqrt(var)
    dev[~np.isfinite(dev) | (dev == 0)] = 1.0
    return dev


def scale(x: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations."""
    return x.mean(0), deviations(x.var(0), pairs)


# What is asked of a block. Answers of blocks add up element by element: numbers and arrays by their sum, lists one after the other.


def _moments(rows: Rows) -> tuple:
    return rows.w.sum(), rows.w @ rows.x


def _spread(rows: Rows, mean: np.ndarray) -> tuple:
    return (rows.w @ (rows.x - mean) ** 2,)


def _drawn_of(rows: Rows, weight: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    upto = np.cumsum(weight)
    at = int(np.searchsorted(upto, rng.random() * upto[-1], "right"))
    return float(upto[-1]), rows.x[min(at, len(rows.x) - 1)]


def _seed(rows: Rows, centers: np.ndarray | None, key: tuple[int, ...]) -> tuple:
    """One row of the block, drawn in proportion to the squared distance from the nearest center, and one drawn evenly, with the weights of all."""
    rng = np.random.default_rng([*key, rows.block])
    even = _drawn_of(rows, rows.w, rng)
    far = (0.0, even[1]) if centers is None else _drawn_of(rows, rows.w * rows.distances(centers).min(1), rng)
    return ([(rows.block, far, even)],)


def _lloyd(rows: Rows, c: np.ndarray) -> tuple:
    """Rows, sums and cost of the centers' clusters, and the row that fits worst."""
    d = rows.distances(c)
    labels, near = d.argmin(1), d.min(1)
    sums = np.stack([np.bincount(labels, rows.w * rows.x[:, j], len(c)) for j in range(rows.x.shape[1])], 1)
    worst = int(near.argmax())
    return np.bincount(labels, rows.w, len(c)), sums, rows.w @ near, [(near[worst], -rows.block, rows.x[worst])]


def _parts(rows: Rows, r: np.ndarray, about: np.ndarray) -> tuple:
    """Sizes, sums and scatter of clusters about given points, rows belonging to them by r."""
    sums, scatter = [], []
    for i, m in enumerate(about):
        off = rows.x - m
        part = off.T * r[:, i]
        sums.append(part.sum(1))
        scatter.append(part @ off)
    return r.sum(0), np.stack(sums), np.stack(scatter)


def _first(rows: Rows, c: np.ndarray) -> tuple:
    return _parts(rows, np.eye(len(c))[rows.distances(c).argmin(1)] * rows.w[:, None], c)


def log_densities(x: np.ndarray, means: np.ndarray, inverse: np.ndarray, constant: np.ndarray) -> np.ndarray:
    out = np.empty((len(means), len(x)))
    for i, (m, s, k) in enumerate(zip(means, inverse, constant, strict=True)):
        z = (x - m) @ s.T
        out[i] = k - 0.5 * np.einsum("ij,ij->i", z, z)
    return out.T


def _expect(rows: Rows, means: np.ndarray, inverse: np.ndarray, constant: np.ndarray) -> tuple:
    logs = log_densities(rows.x, means, inverse, constant)
    top = logs.max(1)
    r = np.exp(logs - top[:, None])
    total = r.sum(1)
    r *= (rows.w / total)[:, None]
    return rows.w @ (top + np.log(total)), np.bincount(logs.argmax(1), rows.w, len(means)), *_parts(rows, r, means)


ANSWERS = {"moments": _moments, "spread": _spread, "seed": _seed, "lloyd": _lloyd, "first": _first, "expect": _expect}


def answer(rows: Rows, ask: tuple) -> tuple:
    kind, *args = ask
    if kind == "scaled":
        mean, dev, inner = args
        return answer(rows.scaled(mean, dev), inner)
    return ANSWERS[kind](rows, *args)


def added(a: tuple, b: tuple) -> tuple:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def alone(steps: Steps, rows: Rows) -> Any:
    """Run a fit over rows in memory."""
    try:
        asked = next(steps)
        while True:
            asked = steps.send([answer(rows, a) for a in asked])
    except StopIteration as end:
        return end.value


def together(many: list[Steps]) -> Steps:
    """Run fits in step; what each returns."""
    out: list = [None] * len(many)
    live: dict[int, list[tuple]] = {}

    def step(i: int, got: list | None) -> None:
        try:
            live[i] = many[i].send(got)
        except StopIteration as end:
            live.pop(i, None)
            out[i] = end.value

    for i in range(len(many)):
        step(i, None)
    while live:
        counts = {i: len(a) for i, a in live.items()}
        got = iter((yield [a for asks in live.values() for a in asks]))
        for i, n in counts.items():
            step(i, [next(got) for _ in range(n)])
    return out


def scaled(steps: Steps, mean: np.ndarray, dev: np.ndarray) -> Steps:
    """A fit over rows less their mean over their deviation."""
    try:
        asked = next(steps)
        while True:
            asked = steps.send((yield [("scaled", mean, dev, a) for a in asked]))
    except StopIteration as end:
        return end.value


def _start(k: int, key: tuple[int, ...], rounds: int) -> Steps:
    """k-means from one start; k-means++: each next center is drawn in proportion to the squared distance from the nearest so far."""
    rng, centers = np.random.default_rng(key), []
    for i in range(k):
        ((found,),) = yield [("seed", np.array(centers) if centers else None, (*key, i))]
        found = sorted(found, key=lambda f: f[0])
        which = 1 if sum(f[1][0] for f in found) > 0 else 2
        upto = np.cumsum([f[which][0] for f in found])
        at = min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), len(found) - 1)
        centers.append(found[at][which][1])
    c = np.array(centers)
    for _ in range(rounds):
        ((n, sums, _, worst),) = yield [("lloyd", c)]
        new = sums / np.where(n > 0, n, 1)[:, None]
        for empty in np.flatnonzero(n == 0):  # a center without rows goes to the row that fits worst
            new[empty] = max(worst, key=lambda f: f[:2])[2]
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-10:
            break
    ((n, _, cost, _),) = yield [("lloyd", c)]
    return cost, c, n


def kmeans_steps(k: int, d: int, seed: int, starts: int = 10, rounds: int = 300) -> Steps:
    if k == 1:
        ((n, sums, _, _),) = yield [("lloyd", np.zeros((1, d)))]
        return Model(sums / n[:, None], n)
    best, least = None, np.inf
    for cost, c, n in (yield from together([_start(k, (seed, s), rounds) for s in range(starts)])):
        if cost < least - 1e-12 or best is None:
            best, least = Model(c, n), cost
    return ordered(best)


def ordered(model: Model) -> Model:
    """Clusters numbered by their centers."""
    order = np.lexsort(model.centers.T[::-1])
    model.centers, model.sizes = model.centers[order], model.sizes[order]
    if model.inverse is not None:
        model.inverse, model.constant = model.inverse[order], model.constant[order]
    return model


def _mixture(k: int, d: int, seed: int, rounds: int, tol: float) -> Steps:
    def fitted(size: np.ndarray, off: np.ndarray, scatter: np.ndarray, about: np.ndarray) -> tuple:
        n, size = size.sum(), size + 10 * np.finfo(float).eps
        off = off / size[:, None]
        covs = scatter / size[:, None, None] - off[:, :, None] * off[:, None, :] + FLOOR * np.eye(d)
        low = np.linalg.cholesky(covs)
        constant = np.log(size / n) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi)
        return about + off, np.linalg.inv(low), constant

    centers = (yield from kmeans_steps(k, d, seed, 1)).centers
    (parts,) = yield [("first", centers)]
    n, now, before = parts[0].sum(), fitted(*parts, centers), -np.inf
    for left in reversed(range(rounds)):
        ((like, sizes, *parts),) = yield [("expect", *now)]
        if abs(like / n - before) < tol or not left:
            break
        before, now = like / n, fitted(*parts, now[0])
    free = k * d + k * d * (d + 1) // 2 + k - 1
    return Model(now[0], sizes, now[1], now[2], float(-2 * like + free * np.log(n)))


def mixture_steps(k: int, d: int, seed: int, starts: int = 1, rounds: int = 100, tol: float = 1e-3) -> Steps:
    """A Gaussian mixture with full covariances, from k-means; bic is of the best start."""
    best: Model | None = None
    for model in (yield from together([_mixture(k, d, seed + s, rounds, tol) for s in range(starts)])):
        if best is None or model.bic < best.bic:
            best = model
    assert best is not None
    return ordered(best)


def bounds(n: int) -> tuple[int, int]:
    """Rows that a cluster must have, and most clusters, for n rows."""
    least = min(n, max(5, min(30, int(np.ceil(n * 0.03))))) if n else 5
    return least, max(1, min(8, n // max(1, least)))


def choose_steps(method: str, n: int, d: int, seed: int) -> Steps:
    """The number of clusters by BIC of a full Gaussian mixture, among those without tiny clusters; 1 is always possible."""
    least, most = bounds(n)

    def tried(k: int) -> Steps:
        try:
            if n > 1:
                model = yield from mixture_steps(k, d, seed, 3)
            else:
                model = yield from kmeans_steps(1, d, seed)
                model.inverse, model.constant, model.bic = np.eye(d)[None], np.zeros(1), 0.0
        except np.linalg.LinAlgError:
            return None
        if method == "gmm":
            return model
        fit = yield from kmeans_steps(k, d, seed)
        fit.bic = model.bic
        return fit

    rows, found = [], []
    for k, fit in enumerate((yield from together([tried(k) for k in range(1, most + 1)])), 1):
        if fit is None:
            rows.append({"k": k, "bic": None, "valid": False, "smallest_cluster": None, "reason": "the fit failed"})
            continue
        small = int(fit.sizes.min())
        ok = k == 1 or small >= least
        rows.append({"k": k, "bic": fit.bic, "valid": ok, "smallest_cluster": small, "reason": None if ok else f"smallest cluster {small} is below {least}"})
        if ok and np.isfinite(fit.bic):
            found.append((fit.bic, k, fit))
    fit = min(found, key=lambda f: f[:2])[2] if found else (yield from kmeans_steps(1, d, seed))
    for r in rows:
        r["selected"] = r["k"] == len(fit.centers)
    fit.diagnostics = rows
    return fit


def fit_steps(d: int, pairs: list[tuple[int, int]], method: str, k: int, standardize: bool, seed: int) -> Steps:
    """Means and deviations that rows are scaled by, and the model of the scaled rows."""
    ((n, total),) = yield [("moments",)]
    mean, dev = np.zeros(d), np.ones(d)
    if standardize:
        mean = total / n
        ((var,),) = yield [("spread", mean)]
        dev = deviations(var / n, pairs)
    steps = choose_steps(method, int(n), d, seed) if k == 0 else mixture_steps(k, d, seed) if method == "gmm" else kmeans_steps(k, d, seed)
    return mean, dev, (yield from scaled(steps, mean, dev))


# Over rows in memory


def labelled(model: Model, rows: Rows) -> Fit:
    if model.inverse is None:
        return Fit(rows.distances(model.centers).argmin(1), model.centers, None, model.bic, model.diagnostics)
    logs = log_densities(rows.x, model.centers, model.inverse, model.constant)
    return Fit(logs.argmax(1), model.centers, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), model.bic, model.diagnostics)


def _over(x: np.ndarray, steps: Steps) -> Fit:
    rows = Rows(x)
    return labelled(alone(steps, rows), rows)


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 300) -> Fit:
    return _over(x, kmeans_steps(k, x.shape[1], seed, starts, rounds))


def mixture(x: np.ndarray, k: int, seed: int = 42, starts: int = 1, rounds: int = 100, tol: float = 1e-3) -> Fit:
    return _over(x, mixture_steps(k, x.shape[1], seed, starts, rounds, tol))


def choose(x: np.ndarray, method: str, seed: int = 42) -> Fit:
    return _over(x, choose_steps(method, len(x), x.shape[1], seed))


def fit_rows(x: np.ndarray, features: list[str], pairs: list[tuple[int, int]], method: str, k: int, standardize: bool, seed: int) -> tuple[Fit, list[dict]]:
    """Labels and a summary of each cluster; centers are in the features' own units."""
    rows = Rows(x)
    mean, dev, model = alone(fit_steps(x.shape[1], pairs, method, k, standardize, seed), rows)
    fit = labelled(model, rows.scaled(mean, dev))
    out = []
    for c, center in enumerate(fit.centers * dev + mean):
        own = x[fit.labels == c]
        stats = {f: {"center": float(center[j]), "mean": float(own[:, j].mean()) if len(own) else None, "std": float(own[:, j].std()) if len(own) else None} for j, f in enumerate(features)}
        out.append({"cluster": c, "sample_size": int(len(own)), "stats": json.dumps(stats)} | {f"{s}_{f}": v for f, q in stats.items() for s, v in q.items()})
    return fit, out
