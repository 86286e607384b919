"""Golden values of the metrics and series, closed forms of the models, and every catalog query with SQL against DuckDB."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import metrics, prepare, prox, stats
from quern.operators import arima, decompose, graph_form, kmeans, linear
from quern.plans import catalog
from quern.sources import readers

SMALL = "/root/testdata/sf0.001"


def test_metric_goldens(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.0), (3.0, 3.5), (4.0, 4.0)], "y double, p double")
    row = df.agg(*[c.alias(k) for k, c in metrics.point_metrics("y", "p").items()]).first()
    want = {"log_loss": -51.80936398851132, "mse": 0.065, "rmse": 0.25495097567963926, "mae": 0.15, "msle": 0.004063330902028265, "rmsle": 0.06374426171843443, "ce": 0.5}
    assert all(math.isclose(row[k], v, rel_tol=1e-9) for k, v in want.items())
    best = metrics.best_thresholds(df, "y", "p").first()
    assert np.allclose([best[f"{k}_opt"] for k in ("f05", "f1", "f2", "mcc", "acc")], [3.2142857142857144, 1.6363636363636365, 1.1363636363636365, 0, 2.75])
    assert [r["rank"] for r in metrics.tied_rank(df, "p").orderBy("p").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("q,phi,theta,values,p,d,steps", [
    (0, [0.34482756, 0.13793102], [], [i % 3 for i in range(10)], 2, 0, 1),
    (2, [], [0.34482756, 0.13793102], [i % 3 for i in range(10)], 0, 0, 1),
    (2, [-2.9589546, 2.8828485], [3.9598641, -0.61601555], [i % 5 + 0.1 * (i % 7 + 1) for i in range(7)], 2, 0, 1),
    (1, [-1.0369391], [1.1154615], [i + i % 3 for i in range(10)], 1, 1, 1),
])
def test_arima_goldens(q, phi, theta, values, p, d, steps):
    got = arima.fit_series(np.array(values, float), p, d, q, steps, compat=True)
    assert np.allclose(got[0], phi, rtol=1e-4) and np.allclose(got[1], theta, rtol=1e-4)


def test_series(spark):
    df = spark.createDataFrame([(0, i, float(i // 2)) for i in range(10)], "s int, t int, v double")
    diff = [r["diff"] for r in prepare.differenced(df, "v", "t", ["s"]).orderBy("t").collect()]
    assert diff == [None, 0, 1, 0, 1, 0, 1, 0, 1, 0]
    assert prepare.lag_matrix(df, "v", "t", ["s"], 3).count() == 7


def test_nominal_codes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("bacab")] + [(9, None)], "k int, v string")
    assert [r["c"] for r in prepare.first_seen_index(df, "v", "k", "c").orderBy("k").collect()] == [0, 1, 2, 1, 0, None]
    assert [r["c"] for r in prepare.label_index(df, "v", "c").orderBy("k").collect()] == [1, 0, 2, 0, 1, None]


def test_elastic_net_satisfies_optimality(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = x @ [1, -2, 0, 0.5] + 3 + 0.1 * rng.normal(size=60)
    df = readers.from_rows(spark, np.column_stack([x, y]))
    lam, alpha = 7.0, 0.4
    m = linear.fit_linear(df, ["x0", "x1", "x2", "x3"], "x4", lam, alpha)
    slope = x.T @ (x @ m.coef + m.intercept - y) + lam * (1 - alpha) * m.coef
    on = np.abs(m.coef) > 1e-9
    assert np.allclose(slope[on], -lam * alpha * np.sign(m.coef[on]), atol=1e-5) and (np.abs(slope[~on]) <= lam * alpha + 1e-6).all()
    path = linear.ElasticNetPath(n_lambdas=10, n_alphas=2).fit(prepare.contiguous_folds(df.withColumn("k", F.monotonically_increasing_id()), "k", 5), ["x0", "x1", "x2", "x3"], "x4", fold="fold")
    assert path.path_frame(spark).count() == 20 and path.best_row["err_cv"] < 0.2
    assert m.score(df, "x4") > 0.9


def test_ridge_and_logistic(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (3.0, 1.0), (4.0, 1.0)], "x double, y double")
    m = linear.logistic_regression(df, ["x"], "y", c=2.0)
    x, y = np.arange(5.0), np.array([0, 1, 0, 1, 1.0])
    p = 1 / (1 + np.exp(-(m.coef[0] * x + m.intercept)))
    assert abs(((p - y) * x).sum() + m.coef[0] / 2) < 1e-4 and abs((p - y).sum()) < 1e-4
    assert abs(linear.ridge(df, ["x"], "y", 10.0).coef[0] - 2.0 / 20.0) < 1e-9


def test_kmeans(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0, 4.0],), ([1.0, 0.0],)], "x array<double>")
    m = kmeans.kmeans(df, "x", 2, init=[[1.0, 1.0], [1.0, 4.0]])
    assert m.centres.tolist() == [[1, 0.5], [1, 4]] and m.inertia == 0.5
    assert [r["label"] for r in m.predict(df).collect()] == [0, 1, 0]
    new, sizes, _ = kmeans.lloyd_step(spark.createDataFrame([([2.0, 2.0],)], "x array<double>"), "x", np.array([[9.0, 9.0], [1.0, 1.0]]))
    assert new.tolist() == [[9, 9], [2, 2]] and sizes.tolist() == [0, 1]
    assert kmeans.kmeans(df, "x", 2, seed=3).centres.shape == (2, 2)


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) * [3, 2, 1] + 5
    df = readers.from_rows(spark, x)
    m = decompose.pca(df, ["x0", "x1", "x2"], 2)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(m.explained_variance, (s**2 / 49)[:2])
    t = decompose.truncated_svd(df, ["x0", "x1", "x2"], 2)
    assert np.allclose(t.singular_values, np.linalg.svd(x, compute_uv=False)[:2])
    wide = stats.gram_matrices(readers.from_rows(spark, rng.normal(size=(20, 30))), [f"x{i}" for i in range(30)])[None]
    assert wide.shape == (31, 31) and wide[0, 0] == 20


@pytest.mark.parametrize("h", prox.NAMES)
def test_prox_is_a_minimum(h):
    value = {"abs": abs, "exp": math.exp, "huber": lambda x: x * x / 2 if abs(x) < 1 else abs(x) - 0.5, "identity": lambda x: x, "logistic": lambda x: math.log1p(math.exp(x)), "maxneg0": lambda x: max(-x, 0), "maxpos0": lambda x: max(x, 0), "negentr": lambda x: x * math.log(x) if x > 0 else 0.0 if x == 0 else math.inf, "neglog": lambda x: -math.log(x) if x > 0 else math.inf, "recipr": lambda x: 1 / x if x > 0 else math.inf, "square": lambda x: x * x / 2, "zero": lambda x: 0.0,
             "indbox01": lambda x: 0 if 0 <= x <= 1 else math.inf, "indeq0": lambda x: 0 if x == 0 else math.inf, "indge0": lambda x: 0 if x >= 0 else math.inf, "indle0": lambda x: 0 if x <= 0 else math.inf}[h]
    for v in (-2.0, -0.3, 0.4, 3.0):
        x = float(prox.prox_numpy(h, np.array([v]), 2.0)[0])
        f = lambda z: value(z) + (z - v) ** 2  # noqa: B023, E731
        assert all(f(x) <= f(x + s) + 1e-7 for s in (-0.1, -1e-3, 1e-3, 0.1))


def test_graph_form_matches_the_lasso(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 2))
    b = a @ [1.0, 0.0] + 0.05 * rng.normal(size=40)
    df = readers.from_rows(spark, np.column_stack([a, b]))
    x = graph_form.solve(df, ["x0", "x1"], {"h": "square"}, {"h": "abs", "c": 3.0}, offset="x2", max_iter=60, tol=1e-5)
    want = linear.fit_linear(df, ["x0", "x1"], "x2", 3.0, 1.0, intercept=False).coef
    assert np.allclose(x, want, atol=5e-3)


def test_readers(spark, tmp_path):
    (tmp_path / "r.txt").write_text("7:\n1,5,2005\n2,3,2005\n8:\n1,4,2005\n")
    assert sorted(map(tuple, readers.read_ratings(spark, str(tmp_path / "r.txt")).collect())) == [(7, 1, 5.0), (7, 2, 3.0), (8, 1, 4.0)]
    (tmp_path / "a.arff").write_text("@relation x\n@attribute a numeric\n@attribute b {u,v}\n@data\n1.5,u\n?,v\n")
    assert [tuple(r) for r in readers.read_arff(spark, str(tmp_path / "a.arff")).collect()] == [(1.5, "u"), (None, "v")]
    (tmp_path / "c.csv").write_text("a,y\n1,2\n3,4\n")
    df, features, label = readers.import_data(spark, str(tmp_path / "c.csv"))
    assert (features, label, df.count()) == (["a", "intercept"], "y", 2)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        cell = lambda v: "null" if v is None or v != v else f"{float(v):.7g}" if isinstance(v, (int, float, np.number)) else str(v)
        return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)


def test_boosting_of_classes_and_early_stopping(spark):
    from quern.operators import trees

    rng = np.random.default_rng(5)
    a = rng.normal(size=(240, 2))
    rows = [(float(x), float(y), float(int(x > -0.5) + int(x > 0.5)), float(x), bool(i % 4 == 0)) for i, (x, y) in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, held boolean")
    m = trees.gradient_boosting_classifier(df, ["a", "b"], "c", n_estimators=3, classes=3)
    assert m.importances()[0][0] == "a" and {"leaf_0", "leaf_1", "leaf_2"} <= set(m.apply(df).columns) and m.apply(df).count() == 240
    full = trees.gradient_boosting_regressor(df, ["a", "b"], "y", n_estimators=20, learning_rate=0.5)
    early = trees.gradient_boosting_regressor(df, ["a", "b"], "y", n_estimators=20, learning_rate=0.5, valid="held", tol=0.05)
    assert early.model.getNumTrees < full.model.getNumTrees == 20
    seen = full.history(df)
    assert len(seen) == 20 and seen[-1] < seen[0]


def test_factorization_stops_on_test_error_and_starts_warm(spark):
    from quern.operators import factorize

    rng = np.random.default_rng(8)
    u, v = rng.uniform(0.5, 1.5, (30, 2)), rng.uniform(0.5, 1.5, (20, 2))
    rows = [(i, j, float(u[i] @ v[j] + rng.normal(0, 0.3)), bool((i + j) % 5 == 0)) for i in range(30) for j in range(20) if (i * 7 + j * 3) % 4]
    df = spark.createDataFrame(rows, "user int, item int, r double, held boolean").cache()
    train, test = df.where("not held"), df.where("held")
    model = factorize.alternate(train, "user", "item", "r", rank=2, lam=0.01, max_iter=3, test=test)
    assert len(model.scores) == 3 and model.scores[2][0] <= model.scores[0][0]
    assert model.users.count() == 30 and model.items.count() == 20
    # The side solved last meets its normal equations.
    f, g = ({r["id"]: np.array(r["features"]) for r in side.collect()} for side in (model.users, model.items))
    for j in range(20):
        own = [(f[i], r) for i, k, r, held in rows if k == j and not held]
        assert np.allclose(sum((x @ g[j] - r) * x for x, r in own) + 0.01 * len(own) * g[j], 0, atol=1e-6)
    warm = factorize.alternate(train, "user", "item", "r", rank=2, lam=0.01, max_iter=1, items=model.items)
    assert warm.scores[0][0] <= model.scores[2][0] * 1.01 and warm.scores[0][1] is None
    early = factorize.alternate(train, "user", "item", "r", rank=2, lam=0.0001, max_iter=8, test=train.withColumn("r", -F.col("r")), patience=1)
    tested = [t for _, t in early.scores]
    assert len(tested) < 8 and len(tested) - 1 - int(np.argmin(tested)) == 2
    assert np.isnan(early.predict(spark.createDataFrame([(99, 1)], "user int, item int")).toPandas()["prediction"][0])
    with pytest.raises(ValueError):
        factorize.alternate(train, "user", "item", "r", patience=1)


def test_kmeans_start_keeps_its_candidates(spark):
    df = spark.createDataFrame([([float(x)],) for x in (0, 1, 2, 50)], "x array<double>")
    start = kmeans.parallel_start(df, "x", 4, seed=2)
    assert sorted(start[:, 0]) == [0, 1, 2, 50]


def test_graph_form_with_a_function_for_each_coordinate(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 2))
    b = a @ [1.0, -2.0] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(float(p), float(q), float(o)) for (p, q), o in zip(a, b)], "p double, q double, o double")
    x = graph_form.solve(df, ["p", "q"], {"h": "square"}, [{"h": "zero"}, {"h": "indge0"}], offset="o", rho=5.0, max_iter=60, tol=1e-6)
    assert np.allclose(x, [a[:, 0] @ b / (a[:, 0] @ a[:, 0]), 0], atol=0.02)  # the second stays at its bound; 200 iterations come within 1e-7
    with pytest.warns(UserWarning, match="not converged"):
        graph_form.solve(df, ["p", "q"], {"h": "square"}, [{"h": "zero"}, {"h": "indge0"}], offset="o", rho=5.0, max_iter=2, tol=1e-12)
    with pytest.raises(ValueError):
        graph_form.solve(df, ["p", "q"], {"h": "square"}, [{"h": "zero"}], offset="o")
