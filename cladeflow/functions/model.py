"""Time-reversible substitution models: rates over sites, generator, eigenbasis and transition probabilities.

These are a handful of numbers for a whole run, so they are made on the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, a: float) -> float:
    lo, hi = 0.0, max(1.0, a)
    while gamma_p(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(a, mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_rates(alpha: float, count: int, median: bool = False) -> list[float]:
    """Rates of equally likely classes of a gamma distribution with mean 1: each class's mean, or its median."""
    if count <= 1:
        return [1.0]
    if alpha < 0.02:
        raise ValueError("alpha must be 0.02 or more")
    if median:
        rates = np.array([gamma_quantile((2 * k + 1) / (2 * count), alpha) / alpha for k in range(count)])
        return (rates * count / rates.sum()).tolist()
    cuts = [gamma_quantile(k / count, alpha) for k in range(1, count)]
    upto = np.array([0.0, *(gamma_p(alpha + 1, c) for c in cuts), 1.0])
    return (np.diff(upto) * count).tolist()


@dataclass(frozen=True)
class Model:
    """GTR with gamma rates. ``rates``: AC, AG, AT, CG, CT, GT. Empty frequencies or weights mean equal ones."""

    rates: tuple[float, ...] = (1.0,) * 6
    freqs: tuple[float, ...] = ()
    alpha: float = 0.3
    ncat: int = 4
    weights: tuple[float, ...] = ()
    median: bool = False
    pinv: float = 0.0
    empirical: bool = False
    site_rates: tuple[float, ...] = field(init=False)

    def __post_init__(self) -> None:
        if len(self.rates) != 6 or min(self.rates) <= 0:
            raise ValueError("six positive rates are needed")
        if len(self.freqs) not in (0, 4) or any(x < 0 for x in self.freqs):
            raise ValueError("no or four frequencies are needed")
        if not 1 <= self.ncat <= 8 or len(self.weights) not in (0, self.ncat):
            raise ValueError("one to eight rate categories, with as many weights, are needed")
        if not 0 <= self.pinv < 1:
            raise ValueError("the share of invariant sites must be in [0, 1)")
        freqs = np.array(self.freqs or (0.25,) * 4, float)
        weights = np.array(self.weights or (1.0,) * self.ncat, float)
        object.__setattr__(self, "freqs", tuple(floored(freqs / freqs.sum()).tolist()))
        object.__setattr__(self, "weights", tuple((weights / weights.sum()).tolist()))
        object.__setattr__(self, "site_rates", tuple(gamma_rates(self.alpha, self.ncat, self.median)))

    def with_freqs(self, freqs: list[float]) -> Model:
        return replace(self, freqs=tuple(freqs))

    @lru_cache(maxsize=64)
    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues, V and its inverse, for the generator scaled to one expected change."""
        pi, q = np.array(self.freqs), np.zeros((4, 4))
        q[np.triu_indices(4, 1)] = self.rates
        q = (q + q.T) * pi
        np.fill_diagonal(q, -q.sum(axis=1))
        q /= -(pi * np.diag(q)).sum()
        root = np.sqrt(pi)
        values, u = np.linalg.eigh((root[:, None] * q / root + (root[:, None] * q / root).T) / 2)
        values[np.abs(values) < 1e-15] = 0
        return values, u / root[:, None], u.T * root

    def transition(self, lengths: np.ndarray) -> np.ndarray:
        """P[length, category, i, j]."""
        values, v, inverse = self.eigen()
        t = np.asarray(lengths, float)[..., None, None] * np.array(self.site_rates)[:, None]
        p = np.einsum("ik,...ck,kj->...cij", v, np.expm1(values * t), inverse) + np.eye(4)
        return np.where((p < 0) & (p > -1e-12), 0.0, p)


def floored(freqs: np.ndarray, least: float = 1e-8) -> np.ndarray:
    freqs = np.where(freqs <= 0, least, freqs)
    return freqs / freqs.sum()


def parse_best_model(text: str, base: Model | None = None) -> Model:
    """The first model line: ``GTR{a/b/c/d/e/f}+FU{..}+G4m{0.5}, ...``; what it doesn't say is taken from ``base``."""
    line = next((x.strip() for x in text.splitlines() if x.strip()), "").split(",")[0]
    if not line.upper().startswith("GTR"):
        raise ValueError(f"not a GTR model: {line!r}")

    def values(pattern: str) -> tuple[float, ...]:
        found = re.search(pattern, line, re.I)
        return tuple(float(x) for x in found[1].split("/")) if found else ()

    own = base or Model()
    gamma = re.search(r"\+G(\d*)(m?)(?:\{([^}]*)\})?", line)
    change: dict = {"empirical": bool(re.search(r"\+F(C|$|\+)", line))}
    if rates := values(r"^GTR\{([^}]*)\}"):
        change["rates"] = rates
    if freqs := values(r"\+F[UO]?\{([^}]*)\}"):
        change["freqs"] = freqs
    change |= {"ncat": int(gamma[1] or 4), "alpha": float(gamma[3] or own.alpha), "median": False} if gamma else {"ncat": 1, "alpha": 1.0}
    return replace(own, **{"weights": (), **change})
