"""Least squares over a sparse matrix of (row, col, value) triples by conjugate gradients, for columns too many for a Gram matrix.

Everything of a row's or a column's length is a table. A step is two joins with an aggregation each (A p by row, then A'(A p) by column); the state by
column is written once a step, and only sums reach the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import discard, sent_if_small, stored


@dataclass
class LeastSquares:
    """``x`` (col, value), the steps taken, and the norm of A'(b - A x) - shift x at the end over that at the start."""

    x: DataFrame
    steps: int
    residual: float


def cgls(matrix: DataFrame, target: DataFrame, shift: float = 0.0, max_iter: int = 200, tol: float = 1e-10) -> LeastSquares:
    """Minimizes |A x - b|**2 + ``shift`` |x|**2; ``matrix`` is (row, col, value) with one value for each place, ``target`` (row, value).

    A column that ``target``'s rows don't reach stays 0. Without ``shift`` the solution of least norm is found. Columns of A are in x, rows of A without a target count 0.
    """
    triples = stored(matrix.where("value <> 0").select("row", "col", F.col("value").cast("double").alias("v")), "triples")
    b = target.select("row", F.col("value").cast("double").alias("b"))
    pulled = triples.join(b, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("b")).alias("s0"))
    first = triples.select("col").distinct().join(pulled, "col", "left").select("col", F.coalesce("s0", F.lit(0.0)).alias("s"))
    state = stored(first.select("col", F.lit(0.0).alias("x"), "s", F.col("s").alias("p")), "krylov")
    start = size = state.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).first()[0]
    steps = 0
    while size > tol * tol * start and start > 0:
        if steps == max_iter:
            warnings.warn(f"not converged in {max_iter} steps", RuntimeWarning, stacklevel=2)
            break
        steps += 1
        ap = stored(triples.join(sent_if_small(state.select("col", "p")), "col").groupBy("row").agg(F.sum(F.col("v") * F.col("p")).alias("q")), "ap")
        aap = triples.join(sent_if_small(ap), "row").groupBy("col").agg(F.sum(F.col("v") * F.col("q")).alias("t"))
        with_t = state.join(aap, "col", "left").withColumn("t", F.coalesce("t", F.lit(0.0)) + F.lit(float(shift)) * F.col("p"))
        met = stored(with_t, "krylov")
        dot = lambda a, c: F.sum(F.col(a) * F.col(c))
        pt = met.agg(dot("p", "t")).first()[0]
        if pt <= 0:
            discard(met, ap)
            break
        alpha = size / pt
        s = F.col("s") - F.lit(alpha) * F.col("t")
        size_new = met.agg(F.sum(s * s)).first()[0]  # from the columns themselves, as differences of sums would cancel
        moved = met.select("col", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), s.alias("s"), (s + F.lit(size_new / size) * F.col("p")).alias("p"))
        newer = stored(moved, "krylov")
        discard(state, ap, met)
        state, size = newer, size_new
    x = stored(state.select("col", F.col("x").alias("value")), "solution")
    discard(triples, state)
    return LeastSquares(x, steps, (size / start) ** 0.5 if start else 0.0)


def times(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(row, value) of A x; rows without a value are absent."""
    own = x.select("col", F.col("value").alias("x"))
    return matrix.join(own, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def project(matrix: DataFrame, x0: DataFrame, y0: DataFrame, tol: float = 1e-10, max_iter: int = 200) -> tuple[DataFrame, DataFrame]:
    """(x, y) with y = A x nearest to (``x0``, ``y0``), tables (col, value) and (row, value); what they lack counts 0."""
    away = y0.select("row", F.col("value").cast("double").alias("value")).unionByName(times(matrix, x0).withColumn("value", -F.col("value")))
    moved = cgls(matrix, away.groupBy("row").agg(F.sum("value").alias("value")), 1.0, max_iter, tol)
    both = x0.select("col", F.col("value").cast("double").alias("value")).unionByName(moved.x)
    x = stored(both.groupBy("col").agg(F.sum("value").alias("value")), "projected")
    discard(moved.x)
    return x, times(matrix, x)
