"""Estimators in pipelines: parameters, saved and loaded models, selection over folds."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from quern.operators import estimators as E
from quern.operators import linear


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 + rng.normal(size=300) * 0.1
    data = [(i, *map(float, r), float(t), float(t > 0), float(np.digitize(t, [-1, 1])), i % 3, i % 7, i % 11) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "i int, a double, b double, c double, y double, flag double, kind double, fold int, user int, item int").repartition(3).withColumn("x", F.array("a", "b", "c"))


XS = ["a", "b", "c"]
MADE = {
    "numbers": (lambda: E.ElasticNet(inputCols=XS, labelCol="y", lam=3.0, alpha=0.5), ["prediction"]),
    "path": (lambda: E.ElasticNet(inputCols=XS, labelCol="y", foldCol="fold", nLambdas=8, nAlphas=2), ["prediction"]),
    "flags": (lambda: E.ElasticNet(inputCols=XS, labelCol="flag", family="logistic", lam=2.0, alpha=0.5), ["prediction", "probability"]),
    "groups": (lambda: E.Clusters(featuresCol="x", k=4, seed=2, distancesCol="d"), ["prediction", "d"]),
    "components": (lambda: E.ComponentsOf(inputCols=XS, k=2, whiten=True), ["c0", "c1"]),
    "svd": (lambda: E.ComponentsOf(inputCols=XS, k=3, method="svd", outputPrefix="s"), ["s0", "s1", "s2"]),
    "factors": (lambda: E.Factorization(ratingCol="y", rank=2, maxIter=2), ["prediction"]),
    "trees": (lambda: E.BoostedTrees(inputCols=XS, labelCol="kind", loss="softmax", nRounds=2, maxDepth=2), ["prediction", "probability"]),
}


@pytest.mark.parametrize("name", MADE)
def test_pipelines_survive_save_and_load(spark, rows, name, tmp_path):
    make, columns = MADE[name]
    stage = make()
    assert stage.copy().extractParamMap().keys() == stage.extractParamMap().keys() and stage.explainParams()
    pipeline = Pipeline(stages=[stage])
    pipeline.save(f"{tmp_path}/pipeline")
    again = Pipeline.load(f"{tmp_path}/pipeline").getStages()[0]
    assert type(again) is type(stage) and {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in stage.extractParamMap().items()}
    model = pipeline.fit(rows)
    model.save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    out = lambda m: [tuple(r) for r in m.transform(rows).select("i", *columns).orderBy("i").collect()]
    assert out(model) == out(loaded) and len(out(model)) == 300
    assert loaded.stages[0].uid == model.stages[0].uid and loaded.stages[0].facts.keys() == model.stages[0].facts.keys()


def test_models_are_those_of_the_operators(rows):
    m = E.ElasticNet(inputCols=XS, labelCol="y", lam=3.0, alpha=0.5).fit(rows)
    want = linear.fit_linear(rows, XS, "y", 3.0, 0.5)
    assert np.allclose(m.coefficients, want.coef) and m.intercept == pytest.approx(want.intercept)
    better = m.copy({m.getParam("predictionCol"): "p"})
    assert "p" in better.transform(rows).columns and np.allclose(better.coefficients, m.coefficients)
    groups = E.Clusters(featuresCol="x", k=3).fit(rows)
    assert groups.score(rows) == pytest.approx(-groups.facts["inertia"])


def test_fold_errors_are_those_of_each_fold(rows):
    stage = E.ElasticNet(inputCols=XS, labelCol="y")
    grid = ParamGridBuilder().addGrid(stage.lam, [0.1, 30.0]).addGrid(stage.alpha, [0.0, 1.0]).build()
    best, errors = E.cross_validate(rows, stage, grid, RegressionEvaluator(labelCol="y"), "fold", ["i", *XS, "y"])
    errors = errors.collect()
    assert len(errors) == 12
    for r in errors:
        p = {k.name: v for k, v in grid[r["map"]].items()}
        m = linear.fit_linear(rows.where(F.col("fold") != r["fold"]), XS, "y", p["lam"], p["alpha"])
        held = m.predict(rows.where(F.col("fold") == r["fold"])).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
        assert r["error"] == pytest.approx(held)
    means = [np.mean([r["error"] for r in errors if r["map"] == i]) for i in range(4)]
    assert np.allclose(best.avgMetrics, means)
    chosen = grid[int(np.argmin(means))]
    assert best.bestModel.facts["lambda"] == chosen[stage.lam]
    with pytest.raises(ValueError):
        E.cross_validate(rows.where("fold = 0"), stage, grid, RegressionEvaluator(labelCol="y"), "fold", ["i", *XS, "y"])


def test_trees_are_chosen_by_folds(rows):
    stage = E.BoostedTrees(inputCols=XS, labelCol="kind", loss="softmax", maxDepth=2, nRounds=2)
    grid = ParamGridBuilder().addGrid(stage.learningRate, [0.01, 1.0]).build()
    best, errors = E.cross_validate(rows.where("fold < 2"), stage, grid, MulticlassClassificationEvaluator(labelCol="kind", metricName="logLoss"), "fold", [*XS, "kind"], parallelism=2)
    means = {r["map"]: r["m"] for r in errors.groupBy("map").agg(F.avg("error").alias("m")).collect()}
    assert means[1] < means[0] and best.bestModel.getOrDefault("learningRate") == 1.0


def test_maps_of_other_parameters_are_fitted_one_by_one(rows):
    stage = E.ElasticNet(inputCols=XS, labelCol="y", lam=1.0)
    grid = ParamGridBuilder().addGrid(stage.fitIntercept, [True, False]).build()
    models = dict(stage.fitMultiple(rows, grid))
    assert models[1].intercept == 0 and models[0].intercept != 0


def test_scores(rows):
    numbers = E.ElasticNet(inputCols=XS, labelCol="y", lam=3.0, alpha=0.5).fit(rows)
    flags = E.ElasticNet(inputCols=XS, labelCol="flag", family="logistic", lam=0.1, alpha=0.5).fit(rows)
    trees = E.BoostedTrees(inputCols=XS, labelCol="y", nRounds=2, learningRate=0.5).fit(rows)
    table = rows.toPandas()
    for m in (numbers, trees):
        p = m.transform(rows).toPandas().sort_values("i")
        y = p["y"]
        assert m.score(rows) == pytest.approx(1 - ((y - p["prediction"]) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and m.score(rows) > 0.3
    assert flags.score(rows) == pytest.approx((flags.transform(rows).toPandas().eval("flag == prediction")).mean()) and flags.score(rows) > 0.9
    x = table[XS].to_numpy()
    centred = x - x.mean(axis=0)
    assert E.ComponentsOf(inputCols=XS, k=2, whiten=True).fit(rows).score(rows) == pytest.approx((np.linalg.svd(centred)[1][:2] ** 2).sum() / (centred**2).sum())
    assert E.ComponentsOf(inputCols=XS, k=1, method="svd").fit(rows).score(rows) == pytest.approx(np.linalg.svd(x)[1][0] ** 2 / (x**2).sum())
    factors = E.Factorization(ratingCol="y", rank=2, maxIter=2).fit(rows)
    p = factors.transform(rows).toPandas()
    assert factors.score(rows) == pytest.approx(-(((p["y"] - p["prediction"]) ** 2).mean() ** 0.5))
