"""The graph-form solver with a function for each row, and conjugate gradients over triples, against dense solutions."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import graph_form as G
from quern.operators import krylov
from quern.operators.decompose import exploded_vector
from quern.sources import readers


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    a = rng.normal(size=(120, 3))
    y = a @ [2.0, -1.0, 0.0] + rng.normal(size=120) * 0.2
    y[::10] += 20
    weight = rng.uniform(0.5, 3, 120)
    data = [(*map(float, r), float(t), float(w), ["square", "huber"][i % 2]) for i, (r, t, w) in enumerate(zip(a, y, weight))]
    return a, y, weight, spark.createDataFrame(data, "p double, q double, r double, o double, w double, h string").repartition(3)


def test_a_function_for_each_row(rows):
    a, y, weight, df = rows
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = G.solve_graph(df, ["p", "q", "r"], {"h_column": "h", "c": "w"}, {"h": "abs", "c": 2.0}, offset="o", tol=1e-7)
    assert got.converged and got.iterations <= 200
    even = np.arange(120) % 2 == 0

    def slope(x):
        e = a @ x - y
        return a.T @ (weight * np.where(even, e, np.clip(e, -1, 1)))

    s = slope(got.z)
    for b, g in zip(got.z, s):  # the subgradient of the whole holds zero
        assert abs(g + 2 * np.sign(b)) < 1e-3 if abs(b) > 1e-6 else abs(g) <= 2 + 1e-3
    again = G.solve_graph(df, ["p", "q", "r"], {"h_column": "h", "c": "w"}, {"h": "abs", "c": 2.0}, offset="o", tol=1e-5, warm=got)
    assert np.allclose(again.x, got.x, atol=1e-4)


def test_a_large_penalty_comes_down(rows):
    df = rows[3]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = G.solve_graph(df, ["p", "q", "r"], {"h": "square"}, {"h": "abs", "c": 1.0}, offset="o", rho=256.0, tol=1e-5, max_iter=80)
    assert got.converged and got.rho < 256


def test_storage_does_not_change_the_steps(rows, monkeypatch):
    df = rows[3]
    take = lambda: G.solve_graph(df, ["p", "q"], {"h": "square"}, {"h": "indge0"}, offset="o", rho=7.0, max_iter=13, tol=0.0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        one = take()
        monkeypatch.setattr(G, "STORE_EVERY", 4)
        two = take()
    assert np.allclose(one.x, two.x, atol=1e-12) and one.rho == two.rho


def test_row_prox_is_that_of_each_row():
    rng = np.random.default_rng(2)
    v, h = rng.normal(size=60), rng.choice(["abs", "square", "huber", "indge0", "zero", "logistic"], 60).astype(object)
    a, b, c, d, e = rng.normal(size=60), rng.normal(size=60), rng.uniform(-0.2, 2, 60), rng.normal(size=60), rng.uniform(0, 1, 60)
    got = G.row_prox(h, v, 1.3, a, b, c, d, e)
    assert np.allclose(got, [G.composite_prox(h[i], v[i : i + 1], 1.3, a[i], b[i], c[i], d[i], e[i])[0] for i in range(60)])


@pytest.mark.parametrize("shift", [0.0, 0.7])
def test_conjugate_gradients_on_triples(spark, shift):
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(40, 12)) * (rng.random((40, 12)) < 0.3)
    dense[:, 5] = 0
    b = rng.normal(size=40)
    matrix = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(12)], "row long, col int, value double").repartition(3)
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "row long, value double")
    got = krylov.cgls(matrix, target, shift)
    want = np.linalg.lstsq(dense, b, rcond=None)[0] if not shift else np.linalg.solve(dense.T @ dense + shift * np.eye(12), dense.T @ b)
    x = np.zeros(12)
    for r in got.x.collect():
        x[r["col"]] = r["value"]
    assert np.allclose(x, want, atol=1e-7) and got.residual < 1e-9 and got.steps <= 30
    with pytest.warns(RuntimeWarning):
        krylov.cgls(matrix, target, shift, max_iter=1)
    assert krylov.cgls(matrix.where("false"), target).x.count() == 0
    if shift:
        x0 = rng.normal(size=12)
        px, py = krylov.project(matrix, spark.createDataFrame([(j, float(v)) for j, v in enumerate(x0)], "col int, value double"), target)
        nearest = np.linalg.solve(dense.T @ dense + np.eye(12), dense.T @ b + x0)
        assert np.allclose([r["value"] for r in px.orderBy("col").collect()], nearest, atol=1e-7)
        by_row = {r["row"]: r["value"] for r in py.collect()}
        assert np.allclose([by_row.get(i, 0.0) for i in range(40)], dense @ nearest, atol=1e-7)
    assert matrix.agg(F.count("*")).first()[0] == 480


def test_triples_go_to_the_graph_form(spark, rows):
    a, y, _, df = rows
    named = df.withColumn("row", F.xxhash64("p", "q", "r", "o"))
    sparse = readers.triples(named, ["p", "q", "r"], "row")
    wide, names = exploded_vector(readers.rows_of_triples(sparse, 3).join(named.select("row", "o"), "row"), "values", 3)
    one = G.solve_graph(wide, names, {"h": "huber"}, {"h": "abs", "c": 1.0}, offset="o", tol=1e-5)
    two = G.solve_graph(df, ["p", "q", "r"], {"h": "huber"}, {"h": "abs", "c": 1.0}, offset="o", tol=1e-5)
    assert np.allclose(one.x, two.x, atol=1e-8)
    odd = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0), (2, 2, 1.0)], "row int, col int, value double")
    assert {r["row"]: r["values"] for r in readers.rows_of_triples(odd, 3).collect()} == {1: [5.0, 0.0, 0.0], 2: [0.0, 0.0, 1.0]}
    with pytest.raises(Exception, match="out of range"):
        readers.rows_of_triples(odd, 2).collect()
