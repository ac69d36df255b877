"""Gaussian-process regression on small groups, in NumPy.

Exact regression by Cholesky factors, and a sparse one by the collapsed variational bound of Titsias
(2009) for groups too large for it.  Hyperparameters are optimised in transformed space: a sigmoid
between bounds where there are any, else the logarithm.
"""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

KERNELS = ("matern12", "matern32", "matern52", "rbf")
PARAMS = ("lengthscales", "kernel_variance", "likelihood_variance")
JITTER = 1e-6


@dataclass
class GPConfig:
    """Settings of one expert's model; scales and bounds are in the data's own units."""

    kernel: str = "matern32"
    coords_scale: Sequence[float] | None = None
    obs_scale: float = 1.0
    obs_mean: float | str | None = None  # a number, 'local' for the mean of the selected rows, or none
    mean_function: str | None = None  # 'constant' adds a fitted constant
    lengthscales: Sequence[float] | float = 1.0
    kernel_variance: float = 1.0
    likelihood_variance: float = 1.0
    bounds: dict[str, tuple] = field(default_factory=dict)
    fixed: Sequence[str] = ()
    num_inducing: int = 500
    max_iter: int = 100
    move_within_tol: float = 1e-8


class Model(Protocol):
    """What an expert's model must offer; any object with these methods can be plugged in.

    ``covariance`` is called by ``predict_covariance`` alone.
    """

    name: str

    def fit(self, x: np.ndarray, y: np.ndarray, c: GPConfig, start: dict[str, np.ndarray] | None, optimise: bool) -> tuple[dict[str, np.ndarray], float, bool]: ...

    def predict(self, x: np.ndarray, y: np.ndarray, c: GPConfig, params: dict[str, np.ndarray], new: np.ndarray) -> dict[str, np.ndarray]: ...

    def covariance(self, x: np.ndarray, c: GPConfig, params: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray: ...


def squared_parts(a: np.ndarray, b: np.ndarray, ell: np.ndarray) -> np.ndarray:
    """Scaled squared differences of each dimension: (d, n, m)."""
    return np.stack([((a[:, k, None] - b[None, :, k]) / ell[k]) ** 2 for k in range(a.shape[1])])


def kernel_of(parts: np.ndarray, kernel: str, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """Kernel matrix, and the factor g with dK / d log l_k = g * parts[k]."""
    r2 = parts.sum(axis=0)
    r = np.sqrt(np.maximum(r2, 1e-30))
    if kernel == "matern12":
        k = np.exp(-r)
        return variance * k, variance * k / r
    if kernel == "matern32":
        e = np.exp(-math.sqrt(3) * r)
        return variance * (1 + math.sqrt(3) * r) * e, 3 * variance * e
    if kernel == "matern52":
        e = np.exp(-math.sqrt(5) * r)
        return variance * (1 + math.sqrt(5) * r + 5 * r2 / 3) * e, variance * 5 / 3 * (1 + math.sqrt(5) * r) * e
    if kernel == "rbf":
        e = np.exp(-0.5 * r2)
        return variance * e, variance * e
    raise ValueError(f"unknown kernel {kernel!r}")


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """BFGS with backtracking; the last flag tells whether it converged."""
    h = np.eye(len(x))
    value, grad = f(x)
    for _ in range(max_iter):
        step = -h @ grad
        slope = float(grad @ step)
        if slope > -1e-16 or not np.isfinite(slope):
            h, step = np.eye(len(x)), -grad
            slope = float(grad @ step)
        step = step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        slope = float(grad @ step)
        t, new = 1.0, None
        while t > 1e-10:
            new = f(x + t * step)
            if np.isfinite(new[0]) and new[0] <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            return x, value, bool(np.abs(grad).max() < 1e-3)
        s, y = t * step, new[1] - grad
        x = x + s
        done = np.abs(new[1]).max() < tol * max(1.0, abs(new[0])) or value - new[0] < 1e-11 * max(1.0, abs(value))
        value, grad = new
        if done:
            return x, value, True
        sy = float(s @ y)
        if sy > 1e-12:
            a = np.eye(len(x)) - np.outer(s, y) / sy
            h = a @ h @ a.T + np.outer(s, s) / sy
    return x, value, False


def _start(c: GPConfig, d: int) -> dict[str, np.ndarray]:
    ell = np.broadcast_to(np.asarray(c.lengthscales, float), (d,)).copy()
    return {"lengthscales": ell, "kernel_variance": np.array([float(c.kernel_variance)]), "likelihood_variance": np.array([float(c.likelihood_variance)])}


class _Space:
    """Packs the free parameters into one unconstrained vector and back."""

    def __init__(self, c: GPConfig, start: dict[str, np.ndarray], scale: np.ndarray):
        self.start, self.names = start, [n for n in PARAMS if n not in c.fixed]
        self.low: dict[str, np.ndarray | None] = {}
        self.high: dict[str, np.ndarray | None] = {}
        for n in self.names:
            lo, hi = c.bounds.get(n, (None, None))
            size = len(start[n])
            unit = scale if n == "lengthscales" else np.ones(size)
            self.low[n] = None if lo is None or hi is None else np.broadcast_to(np.asarray(lo, float), (size,)) / unit
            self.high[n] = None if lo is None or hi is None else np.broadcast_to(np.asarray(hi, float), (size,)) / unit
        self.tol = c.move_within_tol

    def pack(self) -> np.ndarray:
        out = []
        for n in self.names:
            v = self.start[n]
            if self.low[n] is None:
                out.append(np.log(v))
                continue
            lo, hi = self.low[n], self.high[n]
            gap = np.minimum(self.tol + 1e-6 * (hi - lo), (hi - lo) / 2)
            p = (np.clip(v, lo + gap, hi - gap) - lo) / (hi - lo)
            out.append(np.log(p / (1 - p)))
        return np.concatenate(out) if out else np.zeros(0)

    def unpack(self, z: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """All parameters, and d log(parameter) / dz of the free ones."""
        params, chain, at = dict(self.start), [], 0
        for n in self.names:
            part = z[at : at + len(self.start[n])]
            at += len(part)
            if self.low[n] is None:
                params[n] = np.exp(np.clip(part, -40, 40))
                chain.append(np.ones(len(part)))
            else:
                p = 1 / (1 + np.exp(-np.clip(part, -40, 40)))
                width = self.high[n] - self.low[n]
                params[n] = self.low[n] + width * p
                chain.append(width * p * (1 - p) / np.maximum(params[n], 1e-300))
        return params, np.concatenate(chain) if chain else np.zeros(0)


def scaled(x: np.ndarray, y: np.ndarray, c: GPConfig) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Scaled coordinates and observations, the mean taken off, and the coordinate scales."""
    scale = np.ones(x.shape[1]) if c.coords_scale is None else np.asarray(c.coords_scale, float)
    mean = float(y.mean()) if c.obs_mean == "local" else float(c.obs_mean or 0.0)
    return x / scale, (y - mean) / c.obs_scale, mean, scale


def from_first(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Coordinates as differences from the first row of ``x``: kernels see differences alone, and dividing
    large coordinates by their scales would round them."""
    return [p - x[:1] if len(x) else p for p in (x, *others)]


class ExactGP:
    name = "exact"

    def objective(self, x: np.ndarray, y: np.ndarray, c: GPConfig, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log marginal likelihood and its gradient by the logarithm of each parameter."""
        parts = squared_parts(x, x, p["lengthscales"])
        k, g = kernel_of(parts, c.kernel, p["kernel_variance"][0])
        ky = k + p["likelihood_variance"][0] * np.eye(len(x))
        try:
            chol = np.linalg.cholesky(ky)
        except np.linalg.LinAlgError:
            return math.inf, {n: np.zeros(len(v)) for n, v in p.items()}
        inv = np.linalg.solve(chol, np.eye(len(x)))
        inv = inv.T @ inv
        y = y - self.constant(inv, y, c)
        alpha = inv @ y
        value = 0.5 * y @ alpha + np.log(np.diag(chol)).sum() + 0.5 * len(y) * math.log(2 * math.pi)
        m = 0.5 * (inv - np.outer(alpha, alpha))
        grads = {
            "lengthscales": np.array([(m * g * part).sum() for part in parts]),
            "kernel_variance": np.array([(m * k).sum()]),
            "likelihood_variance": np.array([np.trace(m) * p["likelihood_variance"][0]]),
        }
        return float(value), grads

    @staticmethod
    def constant(inv: np.ndarray, y: np.ndarray, c: GPConfig) -> float:
        """Generalised least-squares mean, if the model has a constant."""
        return float((inv @ y).sum() / inv.sum()) if c.mean_function == "constant" else 0.0

    def fit(self, x, y, c, start=None, optimise=True):
        x, y, _, scale = scaled(*from_first(x), y, c)
        first = {**_start(c, x.shape[1]), **(start or {})}
        space = _Space(c, first, scale)
        if not optimise or not space.names:
            return first, self.objective(x, y, c, first)[0], False

        def f(z: np.ndarray) -> tuple[float, np.ndarray]:
            p, chain = space.unpack(z)
            value, grads = self.objective(x, y, c, p)
            return value, np.concatenate([grads[n] for n in space.names]) * chain

        z, value, ok = minimise(f, space.pack(), c.max_iter)
        return space.unpack(z)[0], value, ok

    def predict(self, x, y, c, params, new):
        x, new = from_first(x, new)
        x, y, mean, scale = scaled(x, y, c)
        new = new / scale
        k, _ = kernel_of(squared_parts(x, x, params["lengthscales"]), c.kernel, params["kernel_variance"][0])
        ks, _ = kernel_of(squared_parts(x, new, params["lengthscales"]), c.kernel, params["kernel_variance"][0])
        chol = np.linalg.cholesky(k + params["likelihood_variance"][0] * np.eye(len(x)))
        a = np.linalg.solve(chol, ks)
        const = 0.0
        if c.mean_function == "constant":
            inv = np.linalg.solve(chol, np.eye(len(x)))
            const = self.constant(inv.T @ inv, y, c)
        f = a.T @ np.linalg.solve(chol, y - const) + const
        var = params["kernel_variance"][0] - (a * a).sum(axis=0)
        return {"f_star": f, "f_var": np.maximum(var, 0), "y_var": np.maximum(var, 0) + params["likelihood_variance"][0], "f_bar": np.full(len(new), mean)}

    def covariance(self, x, c, params, a, b):
        """Posterior covariance between two sets of locations."""
        x, a, b = from_first(x, a, b)
        x, _, _, scale = scaled(x, np.zeros(len(x)), c)
        k = lambda p, q: kernel_of(squared_parts(p, q, params["lengthscales"]), c.kernel, params["kernel_variance"][0])[0]
        chol = np.linalg.cholesky(k(x, x) + params["likelihood_variance"][0] * np.eye(len(x)))
        left, right = (np.linalg.solve(chol, k(x, p / scale)) for p in (a, b))
        return k(a / scale, b / scale) - left.T @ right


class SparseGP:
    """Inducing points are observations, chosen by a fixed shuffle of the sorted rows."""

    name = "sparse"

    @staticmethod
    def inducing(x: np.ndarray, c: GPConfig) -> np.ndarray:
        order = np.lexsort(x.T)
        picked = np.random.default_rng(0).permutation(len(x))[: c.num_inducing]
        return x[order[np.sort(picked)]]

    def _factors(self, x, c, p, z):
        s2, noise = p["kernel_variance"][0], p["likelihood_variance"][0]
        kzz, _ = kernel_of(squared_parts(z, z, p["lengthscales"]), c.kernel, s2)
        kzx, _ = kernel_of(squared_parts(z, x, p["lengthscales"]), c.kernel, s2)
        lz = np.linalg.cholesky(kzz + JITTER * s2 * np.eye(len(z)))
        a = np.linalg.solve(lz, kzx) / math.sqrt(noise)
        lb = np.linalg.cholesky(np.eye(len(z)) + a @ a.T)
        return s2, noise, lz, a, lb

    def objective(self, x, y, c, p, z) -> float:
        """Negative collapsed bound."""
        try:
            s2, noise, _, a, lb = self._factors(x, c, p, z)
        except np.linalg.LinAlgError:
            return math.inf
        v = np.linalg.solve(lb, a @ y) / math.sqrt(noise)
        trace = len(x) * s2 / noise - (a * a).sum()
        return float(0.5 * len(x) * math.log(2 * math.pi * noise) + np.log(np.diag(lb)).sum() + 0.5 * (y @ y / noise - v @ v) + 0.5 * trace)

    def fit(self, x, y, c, start=None, optimise=True):
        x, y, _, scale = scaled(*from_first(x), y, c)
        z = self.inducing(x, c)
        first = {**_start(c, x.shape[1]), **(start or {})}
        space = _Space(c, first, scale)
        if not optimise or not space.names:
            return first, self.objective(x, y, c, first, z), False

        def f(t: np.ndarray) -> tuple[float, np.ndarray]:
            value = lambda s: self.objective(x, y, c, space.unpack(s)[0], z)
            e = 1e-5 * np.eye(len(t))
            return value(t), np.array([(value(t + d) - value(t - d)) / 2e-5 for d in e])

        t, value, ok = minimise(f, space.pack(), c.max_iter, tol=1e-5)
        return space.unpack(t)[0], value, ok

    def predict(self, x, y, c, params, new):
        x, new = from_first(x, new)
        x, y, mean, scale = scaled(x, y, c)
        z, new = self.inducing(x, c), new / scale
        s2, noise, lz, a, lb = self._factors(x, c, params, z)
        v = np.linalg.solve(lb, a @ y) / math.sqrt(noise)
        ks, _ = kernel_of(squared_parts(z, new, params["lengthscales"]), c.kernel, s2)
        u = np.linalg.solve(lz, ks)
        w = np.linalg.solve(lb, u)
        var = np.maximum(s2 - (u * u).sum(axis=0) + (w * w).sum(axis=0), 0)
        return {"f_star": w.T @ v, "f_var": var, "y_var": var + noise, "f_bar": np.full(len(new), mean)}

    def covariance(self, x, c, params, a, b):
        """Posterior covariance between two sets of locations."""
        x, a, b = from_first(x, a, b)
        x, _, _, scale = scaled(x, np.zeros(len(x)), c)
        z = self.inducing(x, c)
        s2, _, lz, _, lb = self._factors(x, c, params, z)
        k = lambda p, q: kernel_of(squared_parts(p, q, params["lengthscales"]), c.kernel, s2)[0]
        u, v = (np.linalg.solve(lz, k(z, p / scale)) for p in (a, b))
        return k(a / scale, b / scale) - u.T @ v + np.linalg.solve(lb, u).T @ np.linalg.solve(lb, v)


MODELS: dict[str, Callable[[], Model]] = {"exact": ExactGP, "sparse": SparseGP}


def model_by_name(name: str | Model) -> Model:
    """A registered model, the class at a path (``package.module:Class`` or with a dot), or the object itself if one is given."""
    if not isinstance(name, str):
        return name
    if name in MODELS:
        return MODELS[name]()
    module, _, attribute = name.replace(":", ".").rpartition(".")
    if not module:
        raise ValueError(f"unknown model {name!r}")
    made = getattr(importlib.import_module(module), attribute)()
    if not all(callable(getattr(made, m, None)) for m in ("fit", "predict")):
        raise TypeError(f"{name!r} has no fit and predict")
    return made
