"""Generalized linear models with elastic-net penalties.

Objective: sum of w * loss + lambda * (alpha * |b|_1 + (1 - alpha) / 2 * |b|_2**2), the intercept free.
For squared loss the rows are read once: the Gram matrices of all folds come from one
aggregation, and whole regularization paths are solved from them. Logistic
models go through ``pyspark.ml`` with the penalty in its terms.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import gram_matrices, linear_sum
from ..plans.stored import discard, stored


def descend(gram: np.ndarray, lam: float, alpha: float, start: np.ndarray | None = None, tol: float = 1e-10, sweeps: int = 20_000, intercept: bool = True) -> np.ndarray:
    """(intercept, coefficients) of the penalized least squares with Gram matrix of (1, x, y), by coordinate descent."""
    n = len(gram) - 2
    if intercept:  # centre: the intercept then drops out of the problem
        w = gram[0, 0] or 1.0
        mean = gram[0] / w
        gram = gram - w * np.outer(mean, mean)
    a, b = gram[1:-1, 1:-1], gram[1:-1, -1]
    x = np.zeros(n) if start is None else start[1:].copy()
    if alpha == 0:
        x = np.linalg.lstsq(a + lam * np.eye(n), b, rcond=None)[0]
    else:
        rest = b - a @ x
        for _ in range(sweeps):
            most = 0.0
            for j in range(n):
                down = a[j, j] + lam * (1 - alpha)
                if down <= 0:
                    continue
                z = rest[j] + a[j, j] * x[j]
                new = math.copysign(max(abs(z) - lam * alpha, 0.0), z) / down
                step = new - x[j]
                if step:
                    rest -= a[:, j] * step
                    x[j] = new
                    most = max(most, abs(step) * math.sqrt(max(a[j, j], 0.0)))
            if most <= tol * (1 + math.sqrt(abs(gram[-1, -1]))):
                break
        else:
            warnings.warn(f"coordinate descent was ended after {sweeps} sweeps at penalty {lam}", RuntimeWarning, stacklevel=2)
    return np.concatenate([[mean[-1] - mean[1:-1] @ x if intercept else 0.0], x])


def _rmse(gram: np.ndarray, beta: np.ndarray) -> float:
    v = np.concatenate([beta, [-1.0]])
    return math.sqrt(max(v @ gram @ v, 0.0) / gram[0, 0]) if gram[0, 0] > 0 else float("nan")


@dataclass
class LinearModel:
    features: list[str]
    beta: np.ndarray

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    @property
    def coef(self) -> np.ndarray:
        return self.beta[1:]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, linear_sum(self.features, self.coef, self.intercept))

    def score(self, df: DataFrame, label: str) -> float:
        """R squared."""
        p = linear_sum(self.features, self.coef, self.intercept)
        row = df.agg(F.sum(F.pow(F.col(label) - p, 2)).alias("r"), (F.var_pop(label) * F.count(label)).alias("t")).first()
        return 1 - row["r"] / row["t"]


class LogisticPathModel(LinearModel):
    """Its ``predict`` gives the probability of 1."""

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, 1 / (1 + F.exp(-linear_sum(self.features, self.coef, self.intercept))))


def newton_sums(rows: DataFrame, models: list, betas: np.ndarray) -> list[dict]:
    """For each model (``betas`` row; it leaves out the fold it is named by) the Gram matrix of (1, x, working response) with
    Newton's weights, its log loss, and that of the fold left out. One pass: a task hands on one array of numbers, whatever its rows."""
    n = betas.shape[1]
    size = (n + 1) ** 2 + 5

    def run(batches):
        total = np.zeros((len(models), size))
        for part in batches:
            if not len(part):
                continue
            x, y, w, k = np.stack(part["x"].to_numpy()), part["y"].to_numpy(), part["w"].to_numpy(), part["k"].to_numpy()
            for i, (name, beta) in enumerate(zip(models, betas)):
                inside = np.ones(len(y), bool) if name is None else k != name
                eta = x @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                slope = np.maximum(p * (1 - p), 1e-10)
                loss = w * (np.maximum(eta, 0) - eta * y + np.log1p(np.exp(-np.abs(eta))))
                full = np.column_stack([x, eta + (y - p) / slope])[inside]
                gram = full.T @ (full * (w * slope)[inside][:, None])
                total[i] += np.concatenate([gram.reshape(-1), [w[inside].sum(), (w * y)[inside].sum(), loss[inside].sum(), w[~inside].sum(), loss[~inside].sum()]])
        yield pd.DataFrame({"s": [total.reshape(-1)]})

    sums = rows.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("c", "v")).groupBy("c").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(models) * size)
    for r in sums:
        flat[r["c"]] = r["v"]
    out = []
    for one in flat.reshape(len(models), size):
        weight, ones, loss, weight_held, loss_held = one[-5:]
        out.append({"gram": one[:-5].reshape(n + 1, n + 1), "weight": weight, "ones": ones, "loss": loss, "weight_held": weight_held, "loss_held": loss_held})
    return out


@dataclass
class ElasticNetPath:
    """Path over alphas and lambdas with given or dealt folds; ``best`` has the least cross-validated error, the first among equals.

    With folds there is a second pass: each fold's best lambda of an alpha, averaged over the folds, gives that alpha's model on all rows in ``refits``.
    """

    n_lambdas: int = 100
    n_alphas: int = 5
    n_folds: int = 0
    lambda_min_ratio: float = 1e-7
    lambdas: list[float] | None = None
    alphas: list[float] | None = None
    fit_intercept: bool = True
    family: str = "elasticnet"
    patience: int = 0
    features: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None, fold: str | None = None, valid: DataFrame | None = None) -> "ElasticNetPath":
        """``fold``: a column of fold numbers; without it rows are dealt to ``n_folds`` by a hash, or nothing is cross-validated.

        Rows that are equal in all features and the label share a dealt fold. Squared loss takes one job for the rows, one for ``valid``; ``family="logistic"`` (labels 0 and 1) one for each Newton step, for all
        alphas and folds at once. With ``patience`` an alpha's path ends after so many lambdas in a row without a smaller error.
        """
        self.features = features
        if fold is None and self.n_folds > 1:
            df, fold = df.withColumn("__fold", F.pmod(F.xxhash64(*features, label), F.lit(self.n_folds)).cast("int")), "__fold"
        if self.family == "logistic":
            return self._fit_logistic(df, features, label, weight, fold, valid)
        grams = gram_matrices(df, [*features, label], weight, fold)
        whole = sum(grams.values())
        held = gram_matrices(valid, [*features, label], weight).get(None) if valid is not None else None
        w = whole[0, 0]
        shift = np.outer(whole[0], whole[0]) / w if self.fit_intercept else 0.0
        top = float(np.abs((whole - shift)[1:-1, -1]).max())
        alphas = self._alphas()
        self.path, self.models, self.refits = [], {}, []
        for ai, alpha in enumerate(alphas):
            warm: dict = {}
            held_errors: list[list[float]] = []
            lambdas = self._lambdas(top, alpha)
            for li, lam in enumerate(lambdas):
                beta = warm[None] = descend(whole, lam, alpha, warm.get(None), intercept=self.fit_intercept)
                errors = []
                for k, g in grams.items() if fold and len(grams) > 1 else ():
                    warm[k] = descend(whole - g, lam, alpha, warm.get(k), intercept=self.fit_intercept)
                    errors.append(_rmse(g, warm[k]))
                held_errors.append(errors)
                row = self._row(ai, li, alpha, lam, beta, _rmse(whole, beta), float(np.mean(errors)) if errors else None, _rmse(held, beta) if held is not None else None)
                self.models[ai, li] = LinearModel(features, beta)
                if self._ended(row):
                    break
            if held_errors[0]:
                lam = float(np.mean([lambdas[i] for i in np.argmin(np.array(held_errors), axis=0)]))
                beta = descend(whole, lam, alpha, intercept=self.fit_intercept)
                self.refits.append({"alpha": float(alpha), "lambda": lam, "err_train": _rmse(whole, beta), "model": LinearModel(features, beta)})
        return self._chosen()

    def _alphas(self) -> list[float]:
        return self.alphas if self.alphas is not None else list(np.linspace(0, 1, self.n_alphas)) if self.n_alphas > 1 else [1.0]

    def _lambdas(self, top: float, alpha: float) -> list[float]:
        return self.lambdas if self.lambdas is not None else list(top / max(alpha, 1e-2) * np.logspace(0, math.log10(self.lambda_min_ratio), self.n_lambdas))

    def _row(self, ai: int, li: int, alpha: float, lam: float, beta: np.ndarray, train: float, cv: float | None, valid: float | None) -> dict:
        number = lambda v: None if v is None else float(v)
        row = {"alpha_idx": ai, "lambda_idx": li, "alpha": float(alpha), "lambda": float(lam), "err_train": number(train), "err_cv": number(cv), "err_valid": number(valid), "dof": int((np.abs(beta[1:]) > 1e-8).sum()), "coef": [float(x) for x in beta[1:]], "intercept": float(beta[0])}
        self.path.append(row)
        return row

    @staticmethod
    def _error(row: dict) -> float:
        return next(x for x in (row["err_cv"], row["err_valid"], row["err_train"]) if x is not None)

    def _ended(self, row: dict) -> bool:
        """Whether the path of the row's alpha has had ``patience`` lambdas in a row without a smaller error."""
        errors = [self._error(r) for r in self.path if r["alpha_idx"] == row["alpha_idx"]]
        first = next(i for i, e in enumerate(errors) if e <= min(errors) + 1e-12)
        return bool(self.patience) and len(errors) - 1 - first >= self.patience

    def _chosen(self) -> "ElasticNetPath":
        self.path.sort(key=lambda r: (r["alpha_idx"], r["lambda_idx"]))
        self.best_row = min(self.path, key=self._error)
        self.best = self.models[self.best_row["alpha_idx"], self.best_row["lambda_idx"]]
        return self

    def _fit_logistic(self, df: DataFrame, features: list[str], label: str, weight: str | None, fold: str | None, valid: DataFrame | None) -> "ElasticNetPath":
        columns = lambda d, f: d.select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(f).cast("int") if f else F.lit(-1)).alias("k"))
        rows = stored(columns(df, fold), "logistic")
        held = stored(columns(valid, None), "logistic") if valid is not None else None
        folds = sorted(r["k"] for r in rows.select("k").distinct().collect()) if fold else []
        models = [None, *folds] if len(folds) > 1 else [None]
        n = len(features) + 1
        zero = np.zeros((len(models), n))
        start = newton_sums(rows, models, zero)
        gradient = start[0]["gram"][:-1, -1]  # of (1, x) by the working response, at probability 1/2
        mean = start[0]["ones"] / start[0]["weight"]
        null = np.zeros(n)
        null[0] = math.log(max(mean, 1e-12) / max(1 - mean, 1e-12)) if self.fit_intercept else 0.0
        centred = gradient - (mean - 0.5) * 4 * start[0]["gram"][:-1, 0] if self.fit_intercept else gradient
        top = float(np.abs(centred[1:]).max())
        alphas = self._alphas()
        self.path, self.models, self.refits = [], {}, []
        lambdas = [self._lambdas(top, alpha) for alpha in alphas]
        betas = {ai: np.tile(null, (len(models), 1)) for ai in range(len(alphas))}
        held_errors: dict[int, list] = {ai: [] for ai in betas}
        live = list(betas)
        for li in range(max(map(len, lambdas))):
            if not live:
                break
            sums = self._newton(rows, models, betas, {ai: (lambdas[ai][li], alphas[ai]) for ai in live})
            outer = newton_sums(held, [None] * len(live), np.array([betas[ai][0] for ai in live])) if held is not None else [None] * len(live)
            for ai, out in zip(list(live), outer, strict=True):
                own = sums[ai]
                errors = [s["loss_held"] / s["weight_held"] for s in own[1:]]
                held_errors[ai].append(errors)
                row = self._row(ai, li, alphas[ai], lambdas[ai][li], betas[ai][0], own[0]["loss"] / own[0]["weight"], float(np.mean(errors)) if errors else None, out["loss"] / out["weight"] if out else None)
                self.models[ai, li] = LogisticPathModel(features, betas[ai][0].copy())
                if self._ended(row):
                    live.remove(ai)
        if len(models) > 1:
            means = {ai: float(np.mean([lambdas[ai][i] for i in np.argmin(np.array(e), axis=0)])) for ai, e in held_errors.items()}
            final = {ai: betas[ai][:1].copy() for ai in betas}
            sums = self._newton(rows, [None], final, {ai: (lam, alphas[ai]) for ai, lam in means.items()})
            self.refits = [{"alpha": float(alphas[ai]), "lambda": lam, "err_train": float(sums[ai][0]["loss"] / sums[ai][0]["weight"]), "model": LogisticPathModel(features, final[ai][0])} for ai, lam in means.items()]
        discard(rows, *([held] if held is not None else []))
        return self._chosen()

    def _newton(self, rows: DataFrame, models: list, betas: dict[int, np.ndarray], penalties: dict[int, tuple[float, float]]) -> dict[int, list[dict]]:
        """Moves the ``betas`` of each key of ``penalties`` {key: (lambda, alpha)} to their optimum, all in the same passes; the sums there.

        A step that makes the objective larger is halved. What has not settled after 100 passes stays as it is, with a warning.
        """
        places = [(key, i) for key in penalties for i in range(len(models))]
        at = np.array([betas[key][i] for key, i in places])
        good, least, out = at.copy(), np.full(len(places), np.inf), [None] * len(places)
        for _ in range(100):
            sums = newton_sums(rows, models * len(penalties), at)
            settled = True
            for j, (key, _) in enumerate(places):
                lam, alpha = penalties[key]
                b = at[j][1:]
                value = sums[j]["loss"] + lam * (alpha * np.abs(b).sum() + (1 - alpha) / 2 * (b @ b))
                if value > least[j] + 1e-10 * (1 + abs(least[j])):
                    at[j] = (at[j] + good[j]) / 2
                    settled = settled and bool(np.abs(at[j] - good[j]).max() <= 1e-8 * (1 + np.abs(good[j]).max()))
                    continue
                good[j], least[j], out[j] = at[j], value, sums[j]
                at[j] = descend(sums[j]["gram"], lam, alpha, good[j], intercept=self.fit_intercept)
                settled = settled and bool(np.abs(at[j] - good[j]).max() <= 1e-8 * (1 + np.abs(at[j]).max()))
            if settled:
                break
        else:
            warnings.warn("Newton steps had not settled after 100 passes", RuntimeWarning, stacklevel=2)
        for j, (key, i) in enumerate(places):
            betas[key][i] = good[j]
        return {key: [out[j] for j, (k, _) in enumerate(places) if k == key] for key in penalties}

    def refit_frame(self, spark: SparkSession) -> DataFrame:
        """(alpha, lambda, err_train, coef, intercept) of each alpha's model on all rows at the folds' mean lambda."""
        rows = [(r["alpha"], r["lambda"], r["err_train"], [float(x) for x in r["model"].coef], r["model"].intercept) for r in self.refits]
        return spark.createDataFrame(rows, "alpha double, lambda double, err_train double, coef array<double>, intercept double")

    def path_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.path], "alpha_idx int, lambda_idx int, alpha double, lambda double, err_train double, err_cv double, err_valid double, dof int, coef array<double>, intercept double")

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.best.predict(df, name)


def fit_linear(df: DataFrame, features: list[str], label: str, lam: float = 0.0, alpha: float = 0.0, weight: str | None = None, intercept: bool = True) -> LinearModel:
    gram = gram_matrices(df, [*features, label], weight)[None]
    return LinearModel(features, descend(gram, lam, alpha, intercept=intercept))


def linear_regression(df, features, label, **kw) -> LinearModel:
    return fit_linear(df, features, label, 0.0, 0.0, **kw)


def ridge(df, features, label, alpha: float = 1.0, **kw) -> LinearModel:
    """Minimizes 1/2 |y - xb|**2 + alpha/2 |b|**2."""
    return fit_linear(df, features, label, alpha, 0.0, **kw)


def lasso(df, features, label, alpha: float = 1.0, **kw) -> LinearModel:
    """Minimizes 1/(2m) |y - xb|**2 + alpha |b|_1 over m rows."""
    gram = gram_matrices(df, [*features, label], kw.pop("weight", None))[None]
    return LinearModel(features, descend(gram, alpha * gram[0, 0], 1.0, intercept=kw.pop("intercept", True)))


class LogisticModel:
    def __init__(self, features: list[str], model):
        self.features, self.model = features, model
        self.coef, self.intercept = np.array(model.coefficients), float(model.intercept)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-linear_sum(self.features, self.coef, self.intercept)))

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.probability())

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, (self.probability() >= 0.5).cast("double"))

    def predict_log_proba(self, df: DataFrame, name: str = "log_probability") -> DataFrame:
        return df.withColumn(name, F.log(self.probability()))


def logistic_regression(df: DataFrame, features: list[str], label: str, c: float = 1.0, penalty: str = "l2", weight: str | None = None, max_iter: int = 500, tol: float = 1e-9) -> LogisticModel:
    """Binary, labels 0 and 1: sum of log losses + 1/c * penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    total = df.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    fit = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1 / (c * total), elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False, maxIter=max_iter, tol=tol)
    fit = fit.setWeightCol(weight) if weight else fit
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(df.withColumn(label, F.col(label).cast("double")))
    return LogisticModel(features, fit.fit(data))
