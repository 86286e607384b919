"""Truncated SVD and principal components: one aggregation for the Gram matrix, its eigenvectors on the driver (columns**2 numbers)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.stats import gram_matrices, linear_sum


@dataclass
class Components:
    features: list[str]
    components: np.ndarray  # k x p
    singular_values: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    mean: np.ndarray
    noise_variance: float | None = None
    whiten: bool = False

    def transform(self, df: DataFrame, prefix: str = "c") -> DataFrame:
        """The rows in the stored components (fitted once, never again)."""
        scale = 1 / np.sqrt(self.explained_variance) if self.whiten else np.ones(len(self.components))
        out = [linear_sum(self.features, v * s, -float(self.mean @ v) * s).alias(f"{prefix}{i}") for i, (v, s) in enumerate(zip(self.components, scale, strict=True))]
        return df.select("*", *out)

    def inverse(self, df: DataFrame, prefix: str = "c", to: str = "r") -> DataFrame:
        scale = np.sqrt(self.explained_variance) if self.whiten else np.ones(len(self.components))
        names = [f"{prefix}{i}" for i in range(len(self.components))]
        return df.select("*", *[linear_sum(names, self.components[:, j] * scale, self.mean[j]).alias(f"{to}{j}") for j in range(len(self.features))])


def power_pairs(a: np.ndarray, k: int, n_iter: int, tol: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs by power iteration with deflation."""
    values, vectors = [], []
    a = a.copy()
    for i in range(k):
        v = np.random.default_rng(seed + i).normal(size=len(a))
        v /= np.linalg.norm(v)
        before = 0.0
        for _ in range(n_iter):
            u = a @ v
            norm = np.linalg.norm(u)
            if norm == 0:
                break
            v, value = u / norm, norm
            if abs(value - before) <= tol * abs(before):
                break
            before = value
        value = float(v @ a @ v)
        a -= value * np.outer(v, v)
        values.append(value)
        vectors.append(v)
    return np.array(values), np.array(vectors).T


def _leading(a: np.ndarray, k: int, algorithm: str, n_iter: int, tol: float, seed: int):
    if algorithm == "power":
        return power_pairs(a, k, n_iter, tol, seed)
    values, vectors = np.linalg.eigh(a)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def _fit(df, features, k, centre, algorithm, n_iter, tol, seed):
    g = gram_matrices(df, features)[None]
    n = g[0, 0]
    mean = g[0, 1:] / max(n, 1)
    spread = g[1:, 1:] - n * np.outer(mean, mean)
    a = spread if centre else g[1:, 1:]
    values, vectors = _leading(a, min(k, len(features)), algorithm, n_iter, tol, seed)
    v = vectors.T
    v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
    return n, mean, spread, np.maximum(values, 0), v


def truncated_svd(df: DataFrame, features: list[str], k: int = 2, algorithm: str = "exact", n_iter: int = 100, tol: float = 1e-5, seed: int = 0) -> Components:
    """Variances over n, as of the transformed columns; no centring."""
    n, mean, spread, values, v = _fit(df, features, k, False, algorithm, n_iter, tol, seed)
    variance = np.einsum("ij,jk,ik->i", v, spread / n, v)
    return Components(features, v, np.sqrt(values), variance, variance / np.trace(spread / n), np.zeros(len(features)))


def pca(df: DataFrame, features: list[str], k: int = 2, whiten: bool = False) -> Components:
    """Centred; variances over n - 1; the noise variance is the mean of what is left."""
    n, mean, spread, values, v = _fit(df, features, k, True, "exact", 0, 0.0, 0)
    variance = values / (n - 1)
    total = np.trace(spread) / (n - 1)
    rest = min(int(n), len(features)) - len(v)
    return Components(features, v, np.sqrt(values), variance, variance / total, mean, float((total - variance.sum()) / rest) if rest > 0 else 0.0, whiten)


def left_factors(df: DataFrame, key: str, fitted: Components, prefix: str = "u") -> tuple[DataFrame, Components]:
    """(key, u0, u1, ...) of U = X V / s for a truncated SVD, and the components with the same signs.

    A column of U is 0 where its singular value is. Its sign is set so that its entry of largest size is positive, the one of the smallest ``key``
    among equal ones; that entry is found by an aggregation, and U is one projection of the rows.
    """
    s = fitted.singular_values
    raw = [linear_sum(fitted.features, v / value) if value > 0 else F.lit(0.0) for v, value in zip(fitted.components, s, strict=True)]
    u = df.select(key, *[c.alias(f"{prefix}{i}") for i, c in enumerate(raw)])
    named = [f"{prefix}{i}" for i in range(len(s))]
    tops = u.agg(*[F.max_by(c, F.struct(F.round(F.abs(c), 12), -F.col(key))).alias(c) for c in named]).first() if isinstance(df.schema[key].dataType, NumericType) else u.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in named]).first()
    signs = np.array([-1.0 if (tops[c] or 0.0) < 0 else 1.0 for c in named])
    turned = replace(fitted, components=fitted.components * signs[:, None])
    return u.select(key, *[(F.col(c) * F.lit(float(g))).alias(c) for c, g in zip(named, signs, strict=True)]), turned


def exploded_vector(df: DataFrame, column: str, size: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """An array column as ``size`` double columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names
