"""Expectation-maximisation of a two-class mixture over agreement patterns, with missing values.

The input is one row per pattern, at most 4 ** k of them, so it runs on the driver whatever the number of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    variables: list[str]
    patterns: np.ndarray
    counts: np.ndarray
    weights: np.ndarray
    zeta: np.ndarray
    is_match: np.ndarray
    p_gamma_jm: np.ndarray
    p_gamma_ju: np.ndarray
    p_m: float
    p_u: float
    levels: list[np.ndarray]
    pgamma_km: list[np.ndarray]
    pgamma_ku: list[np.ndarray]
    iterations: int
    converged: bool
    threshold: float
    comparisons: int


def _share(name: str, value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in 0..1, not {value}")
    return min(value, 1 - 1e-5)


def fit(
    patterns: np.ndarray, counts: np.ndarray, dims: tuple[int, int], variables: list[str], p_m: float = 0.1, iter_max: int = 5000, tol: float = 1e-5,
    prior_lambda: float = 0.0, w_lambda: float = 0.0, prior_pi: float = 0.0, w_pi: float = 0.0, address_field: list[bool] | None = None,
    threshold_match: float = 0.85, u_b: float = 1e10, seed: int | None = None, digit_precision: int = 16,
) -> Fit:
    """Fits to patterns [n, k] of levels 0, 1, 2 and 3 (missing), each with a count.

    Starts from the means of the Dirichlet distributions that a seed would draw from. Level probabilities of matches are kept ascending, those of
    non-matches descending. digit_precision is accepted and has no effect: everything is done in double precision in log space.
    """
    k = patterns.shape[1]
    order = np.lexsort(patterns.T[::-1])
    patterns, n = patterns[order], counts[order].astype(float)
    address = list(address_field or [False] * k)
    if (prior_pi or w_pi) and not (prior_lambda and w_lambda):
        raise ValueError("prior_pi needs prior_lambda and w_lambda")
    mu = psi = 1.0
    expected = prior_lambda * dims[0] * dims[1]
    if prior_lambda and w_lambda:
        _share("prior_lambda", prior_lambda)
        w = _share("w_lambda", w_lambda)
        mu = prior_lambda * (w / (1 - w)) * dims[0] * dims[1] + 1
        psi = (1 - prior_lambda) * mu / prior_lambda
    extra = (0.0, 0.0)
    if prior_pi and w_pi:
        _share("prior_pi", prior_pi)
        w = _share("w_pi", w_pi)
        a0 = w / (1 - w) * prior_pi * expected + 1
        extra = (a0, a0 * (1 - prior_pi) / prior_pi)
    levels = [np.unique(c[c < 3]) for c in patterns.T]
    at = [np.where(c < 3, np.searchsorted(u, np.minimum(c, u[-1] if len(u) else 0)), len(u)) for c, u in zip(patterns.T, levels, strict=True)]
    rng = np.random.default_rng(seed) if seed is not None else None
    alphas = [np.arange(len(u)) * 50.0 + 1 for u in levels]
    draw = (lambda a: rng.dirichlet(a)) if rng else (lambda a: a / a.sum())
    pk_m = [np.sort(draw(a)) if len(a) else a for a in alphas]
    pk_u = [np.sort(draw(a))[::-1] if len(a) else a for a in alphas]
    p_u, rounds, change = 1 - p_m, 1, math.inf
    while change > tol:
        with np.errstate(divide="ignore"):
            ll_m = sum((np.append(np.log(p), 0.0)[i] for p, i in zip(pk_m, at, strict=True)), np.zeros(len(n)))
            ll_u = sum((np.append(np.log(p), 0.0)[i] for p, i in zip(pk_u, at, strict=True)), np.zeros(len(n)))
            a, b = ll_m + np.log(p_m), ll_u + np.log(p_u)
        both = np.logaddexp(a, b)
        zeta = np.where(np.isneginf(both), 0.0, np.exp(a - np.where(np.isneginf(both), 0, both)))
        before = np.concatenate([[p_m, p_u], *pk_m, *pk_u])
        r = n * zeta
        total = psi - mu + n.sum()
        p_m = float((r.sum() + mu - 1) / total) if total > 0 else p_m  # no pairs tell nothing
        p_u = 1 - p_m
        for i in range(k):
            size = len(levels[i])
            if not size:
                continue
            m = np.sort(np.bincount(at[i], r, size + 1)[:size])
            if address[i]:
                m = m + np.array([extra[0], *[extra[1]] * (size - 1)])
            u = np.sort(np.bincount(at[i], n - r, size + 1)[:size])[::-1]
            pk_m[i] = m / m.sum() if m.sum() > 0 else pk_m[i]
            pk_u[i] = u / u.sum() if u.sum() > 0 else pk_u[i]
        change = float(np.abs(np.concatenate([[p_m, p_u], *pk_m, *pk_u]) - before).max())
        rounds += 1
        if rounds > iter_max:
            break
    with np.errstate(invalid="ignore"):
        weights = ll_m - ll_u
    normal = lambda x: np.exp(x) / np.exp(x).sum()
    is_match = (zeta >= threshold_match) & (weights <= u_b)
    return Fit(variables, patterns, n.astype(np.int64), weights, zeta, is_match, normal(ll_m), normal(ll_u), p_m, p_u, levels, pk_m, pk_u, rounds, change <= tol, threshold_match, dims[0] * dims[1])
