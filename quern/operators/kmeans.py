"""k-means: Lloyd steps as one narrow projection and one partial aggregation each; k-means|| or random rows to begin with."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import square_distance


def distances(features: Column, centres: np.ndarray) -> Column:
    """Squared distances to each centre (k x d numbers, sent as literals of the plan)."""
    return F.array(*[square_distance(features, F.lit(np.asarray(c, float))) for c in centres])


def nearest(d: Column) -> Column:
    """Index of the smallest distance, the lowest index among equals."""
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def lloyd_step(df: DataFrame, features: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(new centres, sizes, inertia); a centre without rows stays."""
    d = centres.shape[1]
    placed = df.select(F.col(features).alias("x"), distances(F.col(features), centres).alias("d")).select("x", nearest(F.col("d")).alias("label"), F.array_min("d").alias("least"))
    rows = placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("least").alias("s"), F.array(*[F.avg(F.get("x", F.lit(i)).cast("double")) for i in range(d)]).alias("c")).collect()
    new, sizes = centres.copy(), np.zeros(len(centres))
    for r in rows:
        new[r["label"]], sizes[r["label"]] = r["c"], r["n"]
    return new, sizes, float(sum(r["s"] for r in rows))


@dataclass
class KMeansModel:
    features: str
    centres: np.ndarray
    inertia: float
    n_iter: int

    def predict(self, df: DataFrame, name: str = "label") -> DataFrame:
        return df.withColumn(name, nearest(distances(F.col(self.features), self.centres)))

    def transform(self, df: DataFrame, name: str = "distances", root: bool = False) -> DataFrame:
        d = distances(F.col(self.features), self.centres)
        return df.withColumn(name, F.transform(d, F.sqrt) if root else d)

    def recreate(self, df: DataFrame, name: str = "centre") -> DataFrame:
        """Each row's centre, as in colour quantization."""
        table = F.array(*[F.lit(np.asarray(c, float)) for c in self.centres])
        return df.withColumn(name, F.get(table, nearest(distances(F.col(self.features), self.centres))))


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        d = np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0) * weights
        chosen.append(points[rng.choice(len(points), p=d / d.sum())] if d.sum() > 0 else points[rng.integers(len(points))])
    return np.array(chosen)


def parallel_start(df: DataFrame, features: str, k: int, seed: int) -> np.ndarray:
    """k-means||: min(8, 2 + ln k) rounds in which a row joins with chance 2k d / sum d, then weighted k-means++ on the few hundred candidates."""
    first = df.orderBy(F.rand(seed)).limit(1).collect()
    if not first:
        raise ValueError("no rows")
    found = np.array([first[0][features]], float)
    for step in range(min(8, int(2 + math.log(k)))):
        cost = df.select(features, F.array_min(distances(F.col(features), found)).alias("d"))
        total = cost.agg(F.sum("d")).first()[0] or 0.0
        if total <= 0:
            break
        new = cost.where(F.rand(seed + 1 + step) < F.col("d") * (2 * k / total)).select(features).collect()  # 2k rows on average
        if new:
            found = np.concatenate([found, np.array([r[features] for r in new], float)])
    found = np.unique(found, axis=0)
    if len(found) <= k:
        more = [r[features] for r in df.select(features).distinct().orderBy(F.rand(seed)).limit(k).collect()]
        chosen = dict.fromkeys(map(tuple, [*found.tolist(), *np.array(more, float).tolist()]))  # those found stay, others fill up
        return np.array(list(chosen)[:k])
    _, sizes, _ = lloyd_step(df, features, found)
    return _plus_plus(found, np.maximum(sizes, 1e-9), k, np.random.default_rng(seed))


def kmeans(df: DataFrame, features: str, k: int = 8, init="k-means||", max_iter: int = 300, tol: float = 1e-4, seed: int = 0) -> KMeansModel:
    """Stops once the squared shifts of all centres sum to less than ``tol``. ``init`` may be an array of centres. Null or non-finite features fail."""
    bad = F.col(features).isNull() | F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(F.assert_true(~bad, F.lit("non-finite value")).isNull()).persist()
    try:
        if isinstance(init, str):
            centres = parallel_start(df, features, k, seed) if init != "random" else np.array([r[features] for r in df.select(features).orderBy(F.rand(seed)).limit(k).collect()], float)
        else:
            centres = np.array(init, float)
        steps, inertia = 0, float("nan")
        for steps in range(1, max_iter + 1):
            new, _, inertia = lloyd_step(df, features, centres)
            shift = float(((new - centres) ** 2).sum())
            centres = new
            if shift < tol:
                break
        else:
            warnings.warn(f"k-means was ended after {max_iter} steps", RuntimeWarning, stacklevel=2)
        _, _, inertia = lloyd_step(df, features, centres)
    finally:
        df.unpersist()
    return KMeansModel(features, centres, inertia, steps)
