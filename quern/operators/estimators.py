"""The fitted operators as ``pyspark.ml`` estimators: parameters, pipelines, cross-validation, and models that are saved and loaded.

A saved model is its parameters, its arrays as rows of a table, and its tables, all written by Spark to the folder it is given.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasTol, HasWeightCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import gram_matrices
from ..plans.stored import discard, stored
from . import boosting, decompose, factorize, kmeans, linear


class _Writer(MLWriter):
    def __init__(self, instance: "_Fitted"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"facts": self.instance.facts, "tables": sorted(self.instance.tables)})
        rows = [(name, list(a.shape), [float(v) for v in a.reshape(-1)]) for name, a in self.instance.arrays.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").write.parquet(f"{path}/arrays")
        for name, df in self.instance.tables.items():
            df.write.parquet(f"{path}/table-{name}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "_Fitted":
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        out = self.kind()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.facts = metadata["facts"]
        out.arrays = {r["name"]: np.array(r["cells"], float).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/arrays").collect()}
        out.tables = {name: spark.read.parquet(f"{path}/table-{name}") for name in metadata["tables"]}
        return out


class _Fitted(Model, MLWritable, MLReadable):
    """A model of small ``arrays``, ``tables`` that may be large, and ``facts`` that JSON can state."""

    def __init__(self) -> None:
        super().__init__()
        self.arrays: dict[str, np.ndarray] = {}
        self.tables: dict[str, DataFrame] = {}
        self.facts: dict = {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def _of(cls, estimator: Params, arrays: dict[str, np.ndarray], facts: dict | None = None, tables: dict[str, DataFrame] | None = None) -> "_Fitted":
        out = cls()
        estimator._copyValues(out)
        out._resetUid(estimator.uid)
        out.arrays, out.facts, out.tables = {k: np.asarray(v, float) for k, v in arrays.items()}, facts or {}, tables or {}
        return out

    def copy(self, extra: dict | None = None) -> "_Fitted":
        out = super().copy(extra)
        out.arrays, out.tables, out.facts = dict(self.arrays), dict(self.tables), dict(self.facts)
        return out


class _Fits(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose constructor takes its parameters by name."""

    def setParams(self, **values) -> "_Fits":
        return self._set(**values)


def _fit_quality(scored: DataFrame, label: str, prediction: str, classes: bool) -> float:
    """Of classes the share told right, of numbers R squared (0 if the labels don't vary)."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    if classes:
        return float(scored.agg(F.avg((y == p).cast("double"))).first()[0] or 0.0)
    rest, spread = scored.agg(F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y)).first()
    return 1 - rest / spread if spread else 0.0


# -- linear models ---------------------------------------------------------------------------------------------------


class _LinearParams(HasInputCols, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol):
    family = Param(Params._dummy(), "family", "elasticnet for numbers, logistic for labels 0 and 1", TypeConverters.toString)
    lam = Param(Params._dummy(), "lam", "penalty; without it the best of a path", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "share of the absolute penalty", TypeConverters.toFloat)
    fitIntercept = Param(Params._dummy(), "fitIntercept", "whether there is an intercept", TypeConverters.toBoolean)
    nLambdas = Param(Params._dummy(), "nLambdas", "penalties of the path", TypeConverters.toInt)
    nAlphas = Param(Params._dummy(), "nAlphas", "shares of the path, if alpha isn't set", TypeConverters.toInt)
    foldCol = Param(Params._dummy(), "foldCol", "column of folds that choose on the path", TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "penalties in a row without a smaller error that end a path", TypeConverters.toInt)


class ElasticNet(_Fits, _LinearParams):
    """Elastic net for numbers or for labels 0 and 1; with ``lam`` one model, without it the path's best by ``foldCol``."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", predictionCol="prediction", probabilityCol="probability", weightCol=None, family="elasticnet", lam=None, alpha=None, fitIntercept=True, nLambdas=100, nAlphas=5, foldCol=None, patience=0):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", probabilityCol="probability", family="elasticnet", fitIntercept=True, nLambdas=100, nAlphas=5, patience=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _value(self, name: str):
        return self.getOrDefault(name) if self.isDefined(name) else None

    def _fit(self, dataset: DataFrame) -> "ElasticNetModel":
        lam, alpha = self._value("lam"), self._value("alpha")
        family, columns = self.getOrDefault("family"), self.getInputCols()
        path = linear.ElasticNetPath(n_lambdas=self.getOrDefault("nLambdas"), n_alphas=self.getOrDefault("nAlphas"), lambdas=None if lam is None else [lam], alphas=[1.0 if alpha is None else alpha] if alpha is not None or lam is not None else None, fit_intercept=self.getOrDefault("fitIntercept"), family=family, patience=self.getOrDefault("patience"))
        path.fit(dataset, columns, self.getLabelCol(), self._value("weightCol"), self._value("foldCol") if lam is None else None)
        return ElasticNetModel._of(self, {"beta": path.best.beta}, {"lambda": path.best_row["lambda"], "alpha": path.best_row["alpha"]})

    def fitMultiple(self, dataset: DataFrame, paramMaps) -> Iterator[tuple[int, "ElasticNetModel"]]:
        """Of squared loss, all maps of penalties and shares are fitted from one Gram matrix, so a grid reads the rows once."""
        penalties = {"lam", "alpha"}
        if self.getOrDefault("family") != "elasticnet" or any(p.name not in penalties for m in paramMaps for p in m) or any(not self.copy(m).isDefined("lam") for m in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        gram = gram_matrices(dataset, [*self.getInputCols(), self.getLabelCol()], self._value("weightCol"))[None]

        def models():
            for i, values in enumerate(paramMaps):
                one = self.copy(values)
                lam, alpha = one.getOrDefault("lam"), one._value("alpha")
                beta = linear.descend(gram, lam, 1.0 if alpha is None else alpha, intercept=self.getOrDefault("fitIntercept"))
                yield i, ElasticNetModel._of(one, {"beta": beta}, {"lambda": lam, "alpha": 1.0 if alpha is None else alpha})

        return _Shared(models())


class _Shared:
    """An iterator that several threads may draw from, as the cross-validator's do."""

    def __init__(self, items: Iterator):
        import threading

        self.items, self.lock = items, threading.Lock()

    def __iter__(self):
        return self

    def __next__(self):
        with self.lock:
            return next(self.items)


class ElasticNetModel(_Fitted, _LinearParams):
    @property
    def coefficients(self) -> np.ndarray:
        return self.arrays["beta"][1:]

    @property
    def intercept(self) -> float:
        return float(self.arrays["beta"][0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, beta, out = self.getInputCols(), self.arrays["beta"], self.getPredictionCol()
        if self.getOrDefault("family") == "logistic":
            p = self.getOrDefault("probabilityCol")
            return linear.LogisticPathModel(columns, beta).predict(dataset, p).withColumn(out, (F.col(p) >= 0.5).cast("double"))
        return linear.LinearModel(columns, beta).predict(dataset, out)

    def score(self, dataset: DataFrame) -> float:
        """R squared, or the share of labels told right."""
        return _fit_quality(self.transform(dataset), self.getLabelCol(), self.getPredictionCol(), self.getOrDefault("family") == "logistic")


# -- groups, components, factors -------------------------------------------------------------------------------------


class _ClusterParams(HasFeaturesCol, HasPredictionCol, HasMaxIter, HasTol, HasSeed):
    k = Param(Params._dummy(), "k", "number of groups", TypeConverters.toInt)
    init = Param(Params._dummy(), "init", "k-means|| or random", TypeConverters.toString)
    distancesCol = Param(Params._dummy(), "distancesCol", "column for the distances to all centres, if set", TypeConverters.toString)


class Clusters(_Fits, _ClusterParams):
    """k-means over a column of arrays."""

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", distancesCol=None, k=8, init="k-means||", maxIter=300, tol=1e-4, seed=0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", k=8, init="k-means||", maxIter=300, tol=1e-4, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ClustersModel":
        m = kmeans.kmeans(dataset, self.getFeaturesCol(), self.getOrDefault("k"), self.getOrDefault("init"), self.getMaxIter(), self.getTol(), self.getSeed())
        return ClustersModel._of(self, {"centres": m.centres}, {"inertia": m.inertia, "steps": m.n_iter})


class ClustersModel(_Fitted, _ClusterParams):
    @property
    def centres(self) -> np.ndarray:
        return self.arrays["centres"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = kmeans.KMeansModel(self.getFeaturesCol(), self.centres, self.facts["inertia"], self.facts["steps"])
        out = m.predict(dataset, self.getPredictionCol())
        return m.transform(out, self.getOrDefault("distancesCol"), root=True) if self.isDefined("distancesCol") else out

    def score(self, dataset: DataFrame) -> float:
        """Less the summed squared distances to the nearest centres."""
        return -float(dataset.agg(F.sum(F.array_min(kmeans.distances(F.col(self.getFeaturesCol()), self.centres)))).first()[0] or 0.0)


class _ComponentParams(HasInputCols):
    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "pca or svd", TypeConverters.toString)
    whiten = Param(Params._dummy(), "whiten", "whether components get unit variance", TypeConverters.toBoolean)
    outputPrefix = Param(Params._dummy(), "outputPrefix", "start of the columns' names", TypeConverters.toString)


class ComponentsOf(_Fits, _ComponentParams):
    """Principal components or a truncated SVD of columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, k=2, method="pca", whiten=False, outputPrefix="c"):
        super().__init__()
        self._setDefault(k=2, method="pca", whiten=False, outputPrefix="c")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ComponentsModel":
        columns, k = self.getInputCols(), self.getOrDefault("k")
        m = decompose.pca(dataset, columns, k, self.getOrDefault("whiten")) if self.getOrDefault("method") == "pca" else decompose.truncated_svd(dataset, columns, k)
        arrays = {n: getattr(m, n) for n in ("components", "singular_values", "explained_variance", "explained_variance_ratio", "mean")}
        return ComponentsModel._of(self, arrays, {"noise_variance": m.noise_variance})


class ComponentsModel(_Fitted, _ComponentParams):
    def _components(self) -> decompose.Components:
        return decompose.Components(self.getInputCols(), **self.arrays, noise_variance=self.facts["noise_variance"], whiten=self.getOrDefault("whiten"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._components().transform(dataset, self.getOrDefault("outputPrefix"))

    def score(self, dataset: DataFrame) -> float:
        """The share of the rows' variance (for SVD: of their squares) that the components hold."""
        m = self._components()
        kept = decompose.replace(m, whiten=False).transform(dataset.select(*m.features), "__c")
        pca = self.getOrDefault("method") == "pca"
        size = lambda c: F.var_pop(c) if pca else F.sum(F.col(c) * F.col(c))
        total = lambda columns: sum((size(c) for c in columns[1:]), size(columns[0]))
        held, whole = kept.agg(total([f"__c{i}" for i in range(len(m.components))]), total(m.features)).first()
        return held / whole if whole else 0.0

    def inverse(self, dataset: DataFrame, to: str = "r") -> DataFrame:
        return self._components().inverse(dataset, self.getOrDefault("outputPrefix"), to)


class _FactorParams(HasPredictionCol, HasMaxIter, HasSeed):
    userCol = Param(Params._dummy(), "userCol", "users", TypeConverters.toString)
    itemCol = Param(Params._dummy(), "itemCol", "items", TypeConverters.toString)
    ratingCol = Param(Params._dummy(), "ratingCol", "ratings", TypeConverters.toString)
    rank = Param(Params._dummy(), "rank", "factors of each user and item", TypeConverters.toInt)
    lam = Param(Params._dummy(), "lam", "penalty for each rating", TypeConverters.toFloat)


class Factorization(_Fits, _FactorParams):
    """Alternating least squares; unseen users and items predict null."""

    @keyword_only
    def __init__(self, *, userCol="user", itemCol="item", ratingCol="rating", predictionCol="prediction", rank=10, lam=0.1, maxIter=10, seed=1234):
        super().__init__()
        self._setDefault(userCol="user", itemCol="item", ratingCol="rating", predictionCol="prediction", rank=10, lam=0.1, maxIter=10, seed=1234)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FactorizationModel":
        user, item, rating = (self.getOrDefault(c) for c in ("userCol", "itemCol", "ratingCol"))
        m = factorize.alternate(dataset.where(F.col(rating).isNotNull()), user, item, rating, self.getOrDefault("rank"), self.getOrDefault("lam"), self.getMaxIter(), seed=self.getSeed(), scored=False)
        return FactorizationModel._of(self, {}, {}, {"users": m.users, "items": m.items})


class FactorizationModel(_Fitted, _FactorParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return factorize.score(dataset, self.tables["users"], self.tables["items"], self.getOrDefault("userCol"), self.getOrDefault("itemCol"), self.getPredictionCol())

    def score(self, dataset: DataFrame) -> float:
        """Less the root of the mean squared error; pairs without factors count as predicted 0."""
        return -float(self.transform(dataset).agg(factorize.rmse(F.col(self.getOrDefault("ratingCol")), F.col(self.getPredictionCol()))).first()[0])


# -- boosted trees ---------------------------------------------------------------------------------------------------


class _BoostParams(HasInputCols, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol, HasSeed):
    loss = Param(Params._dummy(), "loss", "squared, logistic or softmax", TypeConverters.toString)
    nRounds = Param(Params._dummy(), "nRounds", "rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "share of each tree's step", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "splits from root to leaf", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "penalty on squared leaf values", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows in a round", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of columns in a tree", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column", TypeConverters.toInt)
    validCol = Param(Params._dummy(), "validCol", "rows held out, if set", TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "rounds without a smaller held-out loss that end it", TypeConverters.toInt)


class BoostedTrees(_Fits, _BoostParams):
    """Gradient boosting of ``quern.operators.boosting``."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", predictionCol="prediction", probabilityCol="probability", weightCol=None, loss="squared", nRounds=100, learningRate=0.1, maxDepth=3, ridge=1.0, subsample=1.0, colsample=1.0, maxBins=64, validCol=None, patience=0, seed=0):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", probabilityCol="probability", loss="squared", nRounds=100, learningRate=0.1, maxDepth=3, ridge=1.0, subsample=1.0, colsample=1.0, maxBins=64, patience=0, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        get = lambda name: self.getOrDefault(name) if self.isDefined(name) else None
        m = boosting.boost(dataset, self.getInputCols(), self.getLabelCol(), get("loss"), get("nRounds"), get("learningRate"), get("maxDepth"), get("ridge"), subsample=get("subsample"), colsample=get("colsample"), max_bins=get("maxBins"), weight=get("weightCol"), valid=get("validCol"), patience=get("patience"), seed=get("seed"))
        return BoostedTreesModel._of(self, {"base": m.base, "classes": m.classes}, {"history": m.history}, {"nodes": m.nodes(dataset.sparkSession)})


class BoostedTreesModel(_Fitted, _BoostParams):
    def boosted(self) -> boosting.Boosted:
        """The model with its trees, read from the table of nodes (trees, not rows: it has rounds * classes * 2**depth rows at most)."""
        columns = self.getInputCols()
        out = boosting.Boosted(columns, self.getOrDefault("loss"), self.arrays["classes"].tolist(), self.arrays["base"].tolist(), history=[tuple(h) for h in self.facts["history"]])
        trees: dict[tuple[int, int], boosting.Tree] = {}
        rows = sorted(self.tables["nodes"].collect(), key=lambda r: (r["round"], r["class"], r["node"]))
        for r in rows:
            trees.setdefault((r["round"], r["class"]), boosting.Tree())
        for r in rows:  # a node's children were made together, in the order of the nodes
            tree = trees[r["round"], r["class"]]
            if r["feature"] is not None:
                tree.split(r["node"], columns.index(r["feature"]), 0, r["threshold"], r["missing_left"], r["gain"])
        for r in rows:
            tree = trees[r["round"], r["class"]]
            tree.value[r["node"]], tree.cover[r["node"]] = r["value"] if r["value"] is not None else 0.0, r["cover"]
        out.rounds = [[trees[r, k] for k in range(len(out.base))] for r in range(1, 1 + max((r for r, _ in trees), default=0))]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.boosted().predict(dataset, self.getPredictionCol(), self.getOrDefault("probabilityCol"))

    def score(self, dataset: DataFrame) -> float:
        """R squared, or the share of labels told right."""
        return _fit_quality(self.transform(dataset), self.getLabelCol(), self.getPredictionCol(), self.getOrDefault("loss") != "squared")


# -- selection by folds ----------------------------------------------------------------------------------------------


def cross_validate(df: DataFrame, estimator: Estimator, grid: list[dict], evaluator, fold: str, columns: list[str], parallelism: int = 4) -> tuple[CrossValidatorModel, DataFrame]:
    """A ``CrossValidator`` over a stored column of folds (0, 1, ...): its model, and (map, params, fold, error) of each fold's model.

    ``columns`` are what the estimator and evaluator read; they and the fold are written once, and all fits read that. The models of
    all folds and maps are fitted side by side, ``parallelism`` at a time, and the best map is fitted again on all rows.
    """
    kept = stored(df.select(*dict.fromkeys([*columns, fold])).withColumn(fold, F.col(fold).cast("int")), "folds")
    n = kept.agg(F.max(fold)).first()[0]
    if n is None or n < 1:
        raise ValueError("cross-validation takes two folds or more")
    found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=n + 1, foldCol=fold, parallelism=parallelism, collectSubModels=True).fit(kept)
    rows = []
    for k, models in enumerate(found.subModels):
        held = kept.where(F.col(fold) == k).persist()
        for i, m in enumerate(models):
            named = json.dumps({p.name: v for p, v in sorted(grid[i].items(), key=lambda x: x[0].name)})
            rows.append((i, named, k, float(evaluator.evaluate(m.transform(held)))))
        held.unpersist()
    discard(kept)
    return found, df.sparkSession.createDataFrame(rows, "map int, params string, fold int, error double")
