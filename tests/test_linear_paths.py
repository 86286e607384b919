"""Paths that end early, the second pass of cross-validation, and logistic models where plain Newton steps overshoot."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import kmeans, linear


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, 4))
    y = x @ [1.0, -0.5, 0.0, 0.2] + rng.normal(size=400) * 2
    data = [(*map(float, r), float(t), float(t > 0), i % 4) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "a double, b double, c double, d double, y double, flag double, fold int").persist()


XS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("family, label", [("elasticnet", "y"), ("logistic", "flag")])
def test_patience_ends_each_alpha(rows, family, label):
    whole = linear.ElasticNetPath(n_lambdas=12, alphas=[0.3, 1.0], family=family).fit(rows, XS, label, fold="fold")
    early = linear.ElasticNetPath(n_lambdas=12, alphas=[0.3, 1.0], family=family, patience=2).fit(rows, XS, label, fold="fold")
    for ai in range(2):
        errors = [r["err_cv"] for r in whole.path if r["alpha_idx"] == ai]
        got = [r["err_cv"] for r in early.path if r["alpha_idx"] == ai]
        first = next((i for i in range(len(errors)) if i - int(np.argmin(errors[: i + 1])) >= 2), len(errors) - 1)
        assert np.allclose(got, errors[: first + 1], rtol=1e-5) and len(got) < 12


@pytest.mark.parametrize("family, label", [("elasticnet", "y"), ("logistic", "flag")])
def test_second_pass_takes_the_folds_mean_lambda(spark, rows, family, label):
    lambdas = [100.0, 10.0, 1.0, 0.1]
    fit = linear.ElasticNetPath(lambdas=lambdas, alphas=[0.5], family=family).fit(rows, XS, label, fold="fold")
    best = []
    for k in range(4):
        errors = []
        for lam in lambdas:
            one = linear.ElasticNetPath(lambdas=[lam], alphas=[0.5], family=family).fit(rows.where(F.col("fold") != k), XS, label, valid=rows.where(F.col("fold") == k))
            errors.append(one.path[0]["err_valid"])
        best.append(lambdas[int(np.argmin(errors))])
    row = fit.refit_frame(spark).first()
    assert row["lambda"] == pytest.approx(np.mean(best))
    alone = linear.ElasticNetPath(lambdas=[row["lambda"]], alphas=[0.5], family=family).fit(rows, XS, label)
    assert np.allclose(row["coef"], alone.path[0]["coef"], atol=1e-6) and row["err_train"] == pytest.approx(alone.path[0]["err_train"])


def test_parted_classes_have_a_penalized_optimum(spark):
    """Labels that one column parts, with rows far out: undamped steps from zero overshoot here."""
    x = [-50.0, -3.0, -1.0, 1.0, 2.0, 60.0]
    df = spark.createDataFrame([(v, float(v > 0)) for v in x], "a double, y double")
    fit = linear.ElasticNetPath(lambdas=[1.0, 1e-3, 1e-6], alphas=[0.0, 0.5], family="logistic").fit(df, ["a"], "y")
    for r in fit.path:
        b, b0 = r["coef"][0], r["intercept"]
        rest = [float(v > 0) - 1 / (1 + np.exp(-(b0 + b * v))) for v in x]
        slope = sum(e * v for e, v in zip(rest, x)) - r["lambda"] * ((1 - r["alpha"]) * b + r["alpha"] * np.sign(b))
        assert abs(sum(rest)) < 1e-5 and abs(slope) < 1e-4, r


def test_what_ends_unsettled_says_so(rows):
    with pytest.warns(RuntimeWarning):
        linear.descend(np.array([[3.0, 1, 1, 1], [1, 2, 1.9, 1], [1, 1.9, 2, 2], [1, 1, 2, 4]]), 0.01, 0.5, sweeps=1)
    with pytest.warns(RuntimeWarning):
        kmeans.kmeans(rows.select(F.array("a", "b").alias("x")), "x", 5, max_iter=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        kmeans.kmeans(rows.select(F.array("a", "b").alias("x")), "x", 2)
