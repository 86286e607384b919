"""Matrix factorization of (user, item, rating) rows by alternating least squares."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dot
from ..plans.stored import discard, sent_if_small, stored
from ..session import ship_package


def factorize(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 10, lam: float = 0.1, max_iter: int = 10, seed: int = 1234):
    """A ``pyspark.ml`` ALS model (penalty lam * number of ratings); unseen users and items predict NaN. Items are solved last."""
    from pyspark.ml.recommendation import ALS

    fit = ALS(rank=rank, maxIter=max_iter, regParam=lam, userCol=item, itemCol=user, ratingCol=rating, seed=seed, coldStartStrategy="nan")
    return fit.fit(ratings)


def score(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, name: str = "prediction") -> DataFrame:
    """Inner products of the factors (id, features) of each pair; null without factors."""
    u = users.select(F.col("id").alias(user), F.col("features").alias("__u"))
    v = items.select(F.col("id").alias(item), F.col("features").alias("__v"))
    return pairs.join(u, user, "left").join(v, item, "left").withColumn(name, dot(F.col("__u"), F.col("__v"))).drop("__u", "__v")


def rmse(actual: Column, predicted: Column) -> Column:
    """A missing prediction counts as 0."""
    return F.sqrt(F.avg(F.pow(actual - F.coalesce(F.nanvl(predicted, F.lit(0.0)), F.lit(0.0)), 2)))


def rank_one_half_step(ratings: DataFrame, factors: DataFrame, user: str, item: str, rating: str, lam: float) -> DataFrame:
    """The exact user factors of rank one, given item factors (item, v): sum r*v / (sum v**2 + n*lam)."""
    joined = ratings.join(factors, item)
    return joined.groupBy(user).agg((F.sum(F.col(rating) * F.col("v")) / (F.sum(F.col("v") * F.col("v")) + F.count("*") * lam)).alias("u"))


#: Rank up to which a normal matrix is one aggregate for each pair of factors; larger ones are summed as arrays in batches.
MOST_SUMS = 16


def _solved(part: pd.DataFrame, rank: int, lam: float) -> pd.DataFrame:
    """Factors of normal matrices (id, n, a, b, r), ``a`` with all rank**2 cells, and the squared error that they leave."""
    normal = np.stack(part["a"].to_numpy()).reshape(-1, rank, rank)
    b = np.stack(part["b"].to_numpy())
    x = np.linalg.solve(normal + lam * part["n"].to_numpy(float)[:, None, None] * np.eye(rank), b[:, :, None])[:, :, 0]
    error = part["r"].to_numpy() - 2 * (b * x).sum(1) + np.einsum("ni,nij,nj->n", x, normal, x)
    return pd.DataFrame({"id": part["id"], "features": list(x), "error": np.maximum(error, 0), "n": part["n"]})


def half_step(ratings: DataFrame, factors: DataFrame, by: str, other: str, rating: str, rank: int, lam: float) -> DataFrame:
    """(id, features, error, n): exact factors of every ``by``, given the stored ``factors`` (id, features) of ``other``, the squared error over its ratings, and their number.

    The normal matrix of a ``by`` is a sum of products for each pair of factors, so a hot one is summed where its ratings are
    before anything is shuffled; only the sums reach numpy. The error follows from the same sums, so no rating is scored.
    """
    ship_package(ratings.sparkSession)
    joined = ratings.join(sent_if_small(factors.select(F.col("id").alias(other), F.col("features").alias("__f"))), other)
    kind = ratings.schema[by].dataType.simpleString()
    schema = f"id {kind}, features array<double>, error double, n long"
    if rank > MOST_SUMS:
        return _wide_half_step(joined.select(F.col(by).alias("id"), F.col(rating).cast("double").alias("r"), F.col("__f").alias("f")), kind, schema, rank, lam)
    at = [F.get("__f", F.lit(i)) for i in range(rank)]
    lower = [(i, j) for i in range(rank) for j in range(i + 1)]
    r = F.col(rating).cast("double")
    sums = joined.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("n"), F.array(*[F.sum(at[i] * at[j]) for i, j in lower]).alias("a"), F.array(*[F.sum(r * f) for f in at]).alias("b"), F.sum(r * r).alias("r"))
    rows, columns = np.array(lower).T

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                full = np.zeros((len(part), rank, rank))
                full[:, rows, columns] = full[:, columns, rows] = np.stack(part["a"].to_numpy())
                yield _solved(part.assign(a=list(full.reshape(len(part), -1))), rank, lam)

    return sums.mapInPandas(solve, schema)


def _wide_half_step(joined: DataFrame, kind: str, schema: str, rank: int, lam: float) -> DataFrame:
    """As ``half_step`` from (id, r, f): a batch hands on one matrix for each of its ids, and the matrices of an id are added where they meet."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 1024):  # at most so many matrices at once
                rows = part.iloc[at : at + 1024]
                names, place = np.unique(rows["id"].to_numpy(), return_inverse=True)
                f, r = np.stack(rows["f"].to_numpy()), rows["r"].to_numpy()
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(len(names)))
                ends = np.append(starts[1:], len(order))
                own = [(f[order[i:j]], r[order[i:j]]) for i, j in zip(starts, ends)]
                yield pd.DataFrame({"id": names, "n": ends - starts, "a": [(x.T @ x).reshape(-1) for x, _ in own], "b": [x.T @ y for x, y in own], "r": [float(y @ y) for _, y in own]})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        one = pd.DataFrame({"id": part["id"].iloc[:1], "n": [int(part["n"].sum())], "a": [np.sum(np.stack(part["a"].to_numpy()), axis=0)], "b": [np.sum(np.stack(part["b"].to_numpy()), axis=0)], "r": [part["r"].sum()]})
        return _solved(one, rank, lam)

    return joined.mapInPandas(partial, f"id {kind}, n long, a array<double>, b array<double>, r double").groupBy("id").applyInPandas(added, schema)


def start_factors(ratings: DataFrame, key: str, rank: int, seed: int = 1234) -> DataFrame:
    """(id, features) of every key: values from 0 to 0.2 by a hash of key, place and seed, the same on any cluster."""
    values = [F.pmod(F.xxhash64(F.col("id"), F.lit(i), F.lit(seed)), F.lit(1_000_003)) / 1_000_003 * 0.2 for i in range(rank)]
    return ratings.select(F.col(key).alias("id")).distinct().select("id", F.array(*values).alias("features"))


@dataclass
class Factors:
    """Stored factors of both sides, and after each iteration the error over training rows and, if given, test rows."""

    user: str
    item: str
    users: DataFrame
    items: DataFrame
    scores: list[tuple[float | None, float | None]] = field(default_factory=list)

    def predict(self, pairs: DataFrame, name: str = "prediction") -> DataFrame:
        return score(pairs, self.users, self.items, self.user, self.item, name)

    def error(self, ratings: DataFrame, rating: str) -> float:
        return self.predict(ratings, "__p").agg(rmse(F.col(rating), F.col("__p"))).first()[0]


def alternate(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 10, lam: float = 0.1, max_iter: int = 100, test: DataFrame | None = None, patience: int | None = None, items: DataFrame | None = None, seed: int = 1234, scored: bool = True) -> Factors:
    """Alternating least squares with a test error after each iteration; users are solved first.

    With ``patience`` it stops once the test error hasn't been at its lowest for more than so many iterations, and gives the last
    factors. Training errors come from the normal matrices; without ``scored`` they are left out. ``items`` (id, features) starts from known factors. Null or missing ratings don't belong in ``ratings``.
    """
    if patience is not None and test is None:
        raise ValueError("stopping early takes test ratings")
    held = stored(items if items is not None else start_factors(ratings, item, rank, seed), "items")
    model, best, best_at = Factors(user, item, None, held), float("inf"), 0
    for step in range(max_iter):
        users = stored(half_step(ratings, model.items, user, item, rating, rank, lam), "users")
        new = stored(half_step(ratings, users, item, user, rating, rank, lam), "items")
        discard(*[x for x in (model.users, model.items) if x is not None])
        model.users, model.items = users, new
        tested = model.error(test, rating) if test is not None else None
        error, n = new.agg(F.sum("error"), F.sum("n")).first() if scored else (None, 0)
        model.scores.append(((error / n) ** 0.5 if n else None, tested))
        if tested is not None and tested < best:
            best, best_at = tested, step
        if patience is not None and step - best_at > patience:
            break
    return model
