"""Checks and seeds that the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd


def usable(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and those as a matrix in double precision.

    Out are nulls, empty and zero vectors, and those with null or non-finite components. Vectors of another
    length than the longest usable one of the batch stay out of the matrix as well; see by_length().
    """
    at, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64) if v.dtype == object else np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any():
            at.append(i)
            rows.append(x)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return np.array(at), np.stack(rows)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded sample of the rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        squares = (c**2).sum(1)
        near = np.concatenate([(-2 * x[s : s + 4096] @ c.T + squares).argmin(1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c
