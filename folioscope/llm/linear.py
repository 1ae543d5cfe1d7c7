"""Logistic regression for fits on bounded samples, and how such samples are drawn."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_FOLD = 2


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4. A null id is in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Newton's method with an L2 penalty. With one class only, a constant: its smoothed share."""
    w = np.ones(len(y)) if w is None else w
    mean, scale = (np.average(x, axis=0, weights=w), np.maximum(x.std(axis=0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = ((w * y).sum() + 0.5) / (w.sum() + 1)
    b = np.zeros(x.shape[1] + 1)
    b[-1] = np.log(share / (1 - share))
    if len(set(y.tolist())) == 2:
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        penalty = np.full(len(b), ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (w * (y - p)) - penalty * b)
            norm = np.abs(step).max()
            b += step * min(1.0, 5.0 / max(norm, 1e-12))
            if norm < 1e-6:
                break
    return Logistic(mean, scale, b[:-1], float(b[-1]))


def hashed_sample(ids: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """The n rows of ids with the smallest seeded hash, whatever the partitions."""
    return ids.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)
