"""Moments, Gram matrices and other single-pass statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, min, max, mean, var, sd, skew, kurt) of each column in one pass: var over n - 1, sd over n, kurt not in excess."""
    made = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.var_samp(c).alias("var"), F.stddev_pop(c).alias("sd"), F.skewness(c).alias("skew"), (F.kurtosis(c) + 3).alias("kurt")) for c in columns]
    return df.agg(F.array(*made).alias("a")).select(F.inline("a"))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, bad): how many values are null, NaN or infinite."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    return df.agg(F.array(*[F.struct(F.lit(c).alias("name"), bad(c).alias("bad")) for c in columns]).alias("a")).select(F.inline("a"))


def lambda_max(df: DataFrame, features: list[str], label: str, weight: str | None = None, intercept: bool = True) -> Column | DataFrame:
    """One row: the largest |sum w x (y - mean y)| over the features, the penalty from which all coefficients are zero."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.agg(F.avg(label).alias("m"), *[F.sum(w * F.col(c) * F.col(label)).alias(f"xy{i}") for i, c in enumerate(features)], *[F.sum(w * F.col(c)).alias(f"x{i}") for i, c in enumerate(features)])
    mean = F.col("m") if intercept else F.lit(0.0)
    each = [F.abs(F.col(f"xy{i}") - mean * F.col(f"x{i}")) for i in range(len(features))]
    return sums.select((F.greatest(*each) if len(each) > 1 else each[0]).alias("lambda_max"))


def gram(df: DataFrame, columns: list[str], weight: str | None = None, by: str | None = None) -> DataFrame:
    """Long form (by, i, j, value) of the sums of w*x_i*x_j, i <= j, with a constant 1 as column 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(w * xs[i] * xs[j]).alias("value")) for i in range(len(xs)) for j in range(i, len(xs))]
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.array(*cells).alias("a")).select(*([by] if by else []), F.inline("a"))


#: Columns up to which a Gram matrix is one expression for each cell; wider ones are summed batch by batch as arrays.
MOST_EXPRESSIONS = 24


def _wide_gram(df: DataFrame, columns: list[str], weight: str | None, by: str | None) -> DataFrame:
    """As ``gram``: each task sums X'WX of its batches and hands on one row of cells a group, which are then added."""
    n = len(columns) + 1
    kind = df.schema[by].dataType.simpleString() if by else "int"
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    rows = df.select((F.col(by) if by else F.lit(0)).alias("k"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), x.alias("x"))

    def run(batches):
        import pandas as pd

        total: dict = {}
        for part in batches:
            for k, g in part.groupby("k"):
                a = np.stack(g["x"].to_numpy())
                total[k] = total.get(k, 0.0) + a.T @ (a * g["w"].to_numpy()[:, None])
        if total:  # a split of a file may have no rows
            yield pd.DataFrame({"k": list(total), "g": [m.reshape(-1) for m in total.values()]})

    sums = rows.mapInPandas(run, f"k {kind}, g array<double>").select("k", F.posexplode("g").alias("c", "v")).groupBy("k", "c").agg(F.sum("v").alias("value"))
    i, j = F.floor(F.col("c") / n).cast("int"), (F.col("c") % n).cast("int")
    return sums.select(*([F.col("k").alias(by)] if by else []), i.alias("i"), j.alias("j"), "value").where("i <= j")


def gram_matrices(df: DataFrame, columns: list[str], weight: str | None = None, by: str | None = None) -> dict:
    """The Gram matrix of (1, columns) as an array, for each value of ``by`` (None: one under the key None).

    One job; the result is (columns + 1)**2 numbers a group, whatever the rows.
    """
    n = len(columns) + 1
    out: dict = {} if by else {None: np.zeros((n, n))}
    cells = gram(df, columns, weight, by) if n <= MOST_EXPRESSIONS else _wide_gram(df, columns, weight, by)
    for r in cells.collect():
        m = out.setdefault(r[by] if by else None, np.zeros((n, n)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"] or 0.0
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def linear_sum(columns: list[str], coefficients, intercept: float = 0.0) -> Column:
    return reduce(lambda s, cx: s + F.lit(float(cx[1])) * F.col(cx[0]), zip(columns, coefficients, strict=True), F.lit(float(intercept)))


def top_by_magnitude(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k rows of largest absolute value."""
    return df.orderBy(F.abs(F.col(value)).desc(), value).limit(k)
