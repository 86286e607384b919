"""The registered queries on the driver's tables, with DuckDB SQL for each that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "confusion_matrices"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, but: tuple = ()) -> DataFrame:
    """Doubles rounded (sums run in any order) and without a negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


_SWEEP = """
WITH g AS (SELECT l_discount AS p, sum(l_quantity * (l_returnflag = 'R')::INT) AS pos, sum(l_quantity * (l_returnflag <> 'R')::INT) AS neg FROM lineitem GROUP BY 1),
t AS (SELECT sum(pos) AS ap, sum(neg) AS an FROM g),
s AS (SELECT p, coalesce(sum(pos) OVER w, 0) AS fn, coalesce(sum(neg) OVER w, 0) AS tn FROM g WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT p, ap - fn AS tp, tn, an - tn AS fp, fn FROM s, t),
x AS (SELECT *, CASE WHEN fp + tn < 1e-15 THEN 0 ELSE fp / (fp + tn) END AS fpr, CASE WHEN tp + fn < 1e-15 THEN 0 ELSE tp / (tp + fn) END AS tpr,
 CASE WHEN sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) < 1e-15 THEN 0 ELSE (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END AS mcc,
 CASE WHEN 2*tp+fn+fp < 1e-15 THEN 0 ELSE 2*tp/(2*tp+fn+fp) END AS f1, CASE WHEN 1.25*tp+.25*fn+fp < 1e-15 THEN 0 ELSE 1.25*tp/(1.25*tp+.25*fn+fp) END AS f05,
 CASE WHEN 5*tp+4*fn+fp < 1e-15 THEN 0 ELSE 5*tp/(5*tp+4*fn+fp) END AS f2, (tp+tn)/(tp+tn+fp+fn) AS acc FROM m)
"""
_R = "round({0}, 6) + 0.0::DOUBLE AS {0}"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("w"))


@query(_SWEEP + "SELECT " + ", ".join(_R.format(c) for c in "p tp tn fp fn fpr tpr mcc f1 f05 f2 acc".split()) + " FROM x")
def confusion_matrices(spark, sf_dir):
    return rounded(M.confusion_matrices(_scored(spark, sf_dir), "y", "score", "w"))


@query(_SWEEP + "SELECT " + ", ".join(f"round(greatest(0, max({c})), 6) + 0.0::DOUBLE AS {c}_opt" for c in "f05 f1 f2 mcc acc".split()) + " FROM x")
def best_thresholds(spark, sf_dir):
    return rounded(M.best_thresholds(_scored(spark, sf_dir), "y", "score", "w"))


# -- metrics, ranks, moments -----------------------------------------------------------------------------------------

from ..functions import prepare as P  # noqa: E402
from ..functions import prox as X  # noqa: E402
from ..functions import stats as S  # noqa: E402
from ..operators import arima as A  # noqa: E402
from ..operators import decompose as D  # noqa: E402
from ..operators import factorize as Z  # noqa: E402
from ..operators import graph_form as G  # noqa: E402
from ..operators import kmeans as K  # noqa: E402
from ..operators import linear as L  # noqa: E402
from ..operators import trees as T  # noqa: E402


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


@query(
    "SELECT " + ", ".join([
        _r("avg(y)", "mean_actual"), _r("avg((y-p)*(y-p))", "mse", 2), _r("sqrt(avg((y-p)*(y-p)))", "rmse", 4), _r("avg(abs(y-p))", "mae", 4),
        _r("avg((ln(1+y)-ln(1+p))*(ln(1+y)-ln(1+p)))", "msle"), _r("sqrt(avg((ln(1+y)-ln(1+p))*(ln(1+y)-ln(1+p))))", "rmsle"), _r("avg((y<>p)::INT::DOUBLE)", "ce"),
    ]) + " FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
)
def point_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    m = M.point_metrics("y", "p")
    digits = {"mse": 2, "rmse": 4, "mae": 4}
    row = df.agg(F.avg("y").alias("mean_actual"), *[c.alias(k) for k, c in m.items() if k != "log_loss"])
    return row.select(*[(F.round(c, digits.get(c, 6)) + F.lit(0.0)).alias(c) for c in row.columns])


@query("SELECT " + _r("avg(-(y*ln(q) + (1-y)*ln(1-q)))", "log_loss") + " FROM (SELECT (l_returnflag='R')::INT::DOUBLE AS y, greatest(1e-15, least(1-1e-15, l_discount*5)) AS q FROM lineitem)")
def log_loss(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_discount") * 5.0).alias("p"))
    return rounded(df.agg(M.point_metrics("y", "p")["log_loss"].alias("log_loss")))


@query("WITH g AS (SELECT l_quantity AS score, count(*) AS n FROM lineitem GROUP BY 1) SELECT score, n, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0::DOUBLE AS rank FROM g")
def tied_rank(spark, sf_dir):
    return M.tied_rank(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("score")), "score")


@query(
    "WITH r AS (SELECT (l_returnflag='R')::INT AS y, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS k FROM lineitem), "
    "s AS (SELECT sum(k) FILTER (y = 1) AS r, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM r) SELECT " + _r("(r - p*(p+1)/2) / (p*(n-p))", "auc", 9) + " FROM s"
)
def auc(spark, sf_dir):
    return rounded(M.auc(_scored(spark, sf_dir), "y", "score"), 9)


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, " + ", ".join([_r(f"min({c})", "min"), _r(f"max({c})", "max"), _r(f"avg({c})", "mean", 4), _r(f"var_samp({c}) / 1e3", "var", 4), _r(f"stddev_pop({c})", "sd", 4)]) + " FROM lineitem" for c in _COLS))
def column_summary(spark, sf_dir):
    out = S.summary(table(spark, sf_dir, "lineitem"), _COLS)
    return out.select("name", "n", *[(F.round(F.col(c) / (1000 if c == "var" else 1), d) + F.lit(0.0)).alias(c) for c, d in (("min", 6), ("max", 6), ("mean", 4), ("var", 4), ("sd", 4))])


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c})) AS bad FROM lineitem" for c in _COLS))
def finite_scan(spark, sf_dir):
    return S.not_finite(table(spark, sf_dir, "lineitem"), _COLS)


@query("WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem) SELECT " + _r("greatest(abs(sum(l_discount*(l_quantity-m))), abs(sum(l_tax*(l_quantity-m))))", "lambda_max", 3) + " FROM lineitem, m")
def lambda_max(spark, sf_dir):
    return rounded(S.lambda_max(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], "l_quantity"), 3)


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_r(f'sum({a}*{b})', 'value', 3)} FROM lineitem" for i, a in enumerate(["1.0::DOUBLE", "l_quantity", "l_discount", "l_tax"]) for j, b in enumerate(["1.0::DOUBLE", "l_quantity", "l_discount", "l_tax"]) if i <= j))
def gram_matrix(spark, sf_dir):
    return rounded(S.gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 3)


# -- models ----------------------------------------------------------------------------------------------------------


def _named(spark, pairs: dict) -> DataFrame:
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in pairs.items()], "name string, value double"), 4)


_NORMAL = """
WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice / 1000) AS my FROM lineitem),
c AS (SELECT sum((l_quantity-mx)*(l_quantity-mx)) + {lam} AS xx, sum((l_discount-mz)*(l_discount-mz)) + {lam} AS zz, sum((l_quantity-mx)*(l_discount-mz)) AS xz,
 sum((l_quantity-mx)*(l_extendedprice/1000-my)) AS xy, sum((l_discount-mz)*(l_extendedprice/1000-my)) AS zy, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my FROM lineitem, s),
b AS (SELECT (xy*zz - zy*xz)/(xx*zz - xz*xz) AS b1, (zy*xx - xy*xz)/(xx*zz - xz*xz) AS b2, mx, mz, my FROM c)
SELECT 'l_quantity' AS name, round(b1, 4) + 0.0::DOUBLE AS value FROM b UNION ALL SELECT 'l_discount', round(b2, 4) + 0.0 FROM b UNION ALL SELECT 'intercept', round(my - b1*mx - b2*mz, 4) + 0.0 FROM b
"""


def _regression(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))


@query(_NORMAL.format(lam=0))
def linear_regression(spark, sf_dir):
    m = L.linear_regression(_regression(spark, sf_dir), ["l_quantity", "l_discount"], "y")
    return _named(spark, dict(zip(m.features, m.coef, strict=True)) | {"intercept": m.intercept})


@query(_NORMAL.format(lam=50))
def ridge_regression(spark, sf_dir):
    m = L.ridge(_regression(spark, sf_dir), ["l_quantity", "l_discount"], "y", alpha=50.0)
    return _named(spark, dict(zip(m.features, m.coef, strict=True)) | {"intercept": m.intercept})


@query(
    "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice/1000) AS my FROM lineitem), g AS (SELECT sum((l_quantity-mx)*(l_quantity-mx)) AS xx, sum((l_quantity-mx)*(l_extendedprice/1000-my)) AS xy FROM lineitem, s), "
    "q AS (SELECT a.alpha, l.lam, xx, xy FROM g, (VALUES (0.0::DOUBLE), (0.5), (1.0)) a(alpha), (VALUES (1000.0::DOUBLE), (100000.0), (10000000.0)) l(lam)) "
    "SELECT alpha, lam AS lambda, round(sign(xy) * greatest(abs(xy) - lam*alpha, 0) / (xx + lam*(1-alpha)), 5) + 0.0::DOUBLE AS coef FROM q"
)
def elastic_net_path(spark, sf_dir):
    fit = L.ElasticNetPath(lambdas=[1e3, 1e5, 1e7], alphas=[0.0, 0.5, 1.0]).fit(_regression(spark, sf_dir), ["l_quantity"], "y")
    return rounded(fit.path_frame(spark).select("alpha", "lambda", F.get("coef", F.lit(0)).alias("coef")), 5)


@query(
    "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice/1000) AS my, count(*) AS n FROM lineitem), g AS (SELECT sum((l_quantity-mx)*(l_quantity-mx)) AS xx, sum((l_quantity-mx)*(l_extendedprice/1000-my)) AS xy, any_value(n) AS n FROM lineitem, s) "
    "SELECT 'l_quantity' AS name, round(sign(xy) * greatest(abs(xy) - 20.0*n, 0) / xx, 4) + 0.0::DOUBLE AS value FROM g"
)
def lasso_regression(spark, sf_dir):
    m = L.lasso(_regression(spark, sf_dir), ["l_quantity"], "y", alpha=20.0)
    return _named(spark, {"l_quantity": m.coef[0]})


@query()
def elastic_net_cross_validated(spark, sf_dir):
    df = P.contiguous_folds(_regression(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "key", 5)
    return L.ElasticNetPath(n_lambdas=20, n_alphas=3).fit(df, ["l_quantity", "l_discount", "l_tax"], "y", fold="fold").path_frame(spark)


@query()
def logistic_regression(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_quantity", "l_discount", "l_tax")
    m = L.logistic_regression(df, ["l_quantity", "l_discount", "l_tax"], "y")
    return _named(spark, dict(zip(m.features, m.coef, strict=True)) | {"intercept": m.intercept})


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _starts(spark, sf_dir, k: int = 4):
    return [r["x"] for r in _vectors(spark, sf_dir).orderBy("vec_id").limit(k).collect()]


_DIST = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
_VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cid, x FROM v ORDER BY vec_id LIMIT 4)"


@query(f"WITH {_VEC}, d AS (SELECT v.vec_id, c.cid, {_DIST} AS d FROM v, c) SELECT vec_id, first(cid ORDER BY d, cid)::INT AS label, round(min(d), 6) + 0.0::DOUBLE AS least FROM d GROUP BY vec_id")
def kmeans_assign(spark, sf_dir):
    import numpy as np

    d = K.distances(F.col("x"), np.array(_starts(spark, sf_dir)))
    return rounded(_vectors(spark, sf_dir).select("vec_id", d.alias("d")).select("vec_id", K.nearest(F.col("d")).alias("label"), F.array_min("d").alias("least")))


@query(
    f"WITH {_VEC}, d AS (SELECT v.vec_id, v.x, c.cid, {_DIST} AS d FROM v, c), l AS (SELECT vec_id, any_value(x) AS x, first(cid ORDER BY d, cid) AS label FROM d GROUP BY vec_id), "
    "e AS (SELECT label, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a FROM l) SELECT label::INT AS label, (i - 1)::INT AS i, round(avg(a), 6) + 0.0::DOUBLE AS value FROM e GROUP BY label, i"
)
def kmeans_step(spark, sf_dir):
    import numpy as np

    new, _, _ = K.lloyd_step(_vectors(spark, sf_dir), "x", np.array(_starts(spark, sf_dir)))
    return rounded(spark.createDataFrame([(k, i, float(x)) for k, c in enumerate(new) for i, x in enumerate(c)], "label int, i int, value double"))


@query()
def kmeans_fit(spark, sf_dir):
    m = K.kmeans(_vectors(spark, sf_dir), "x", 10, seed=1)
    return m.predict(_vectors(spark, sf_dir)).select("vec_id", "label")


@query("WITH m AS (SELECT var_samp(l_quantity) + var_samp(l_discount*100) + var_samp(l_tax*100) AS t FROM lineitem) SELECT " + _r("t", "total", 4) + " FROM m")
def pca_total_variance(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    m = D.pca(df, ["l_quantity", "d", "t"], 3)
    return rounded(spark.createDataFrame([(float(m.explained_variance.sum()),)], "total double"), 4)


@query()
def pca_embeddings(spark, sf_dir):
    df, names = D.exploded_vector(_vectors(spark, sf_dir), "x", 64)
    return D.pca(df, names, 4).transform(df).select("vec_id", "c0", "c1", "c2", "c3")


@query()
def truncated_svd_embeddings(spark, sf_dir):
    df, names = D.exploded_vector(_vectors(spark, sf_dir), "x", 64)
    return D.truncated_svd(df, names, 4).transform(df).select("vec_id", "c0", "c1", "c2", "c3")


_RATINGS = "r AS (SELECT l_partkey AS item, l_suppkey AS \"user\", avg(l_quantity) AS r FROM lineitem GROUP BY 1, 2)"


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("user")).agg(F.avg("l_quantity").alias("r"))


@query(f"WITH {_RATINGS}, f AS (SELECT *, 1.0 + item % 7 AS v FROM r) SELECT \"user\", round(sum(r*v)/(sum(v*v) + count(*)*0.5), 6) + 0.0::DOUBLE AS u FROM f GROUP BY 1")
def als_half_step(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    factors = r.select("item").distinct().withColumn("v", (1.0 + F.col("item") % 7).cast("double"))
    return rounded(Z.rank_one_half_step(r, factors, "user", "item", "r", 0.5))


@query(
    f"WITH {_RATINGS}, f AS (SELECT *, 1.0 + item % 7 AS v, 0.5 + item % 3 AS w FROM r), s AS (SELECT \"user\", sum(v*v) + count(*)*0.5 AS a, sum(v*w) AS b, sum(w*w) + count(*)*0.5 AS c, sum(r*v) AS d, sum(r*w) AS e FROM f GROUP BY 1) "
    "SELECT \"user\", round((d*c - e*b) / (a*c - b*b), 6) + 0.0::DOUBLE AS u0, round((e*a - d*b) / (a*c - b*b), 6) + 0.0::DOUBLE AS u1 FROM s"
)
def als_half_step_rank_two(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    factors = r.select("item").distinct().select(F.col("item").alias("id"), F.array((1.0 + F.col("item") % 7).cast("double"), (0.5 + F.col("item") % 3).cast("double")).alias("features"))
    found = Z.half_step(r, factors, "user", "item", "r", 2, 0.5)
    return rounded(found.select(F.col("id").alias("user"), F.get("features", F.lit(0)).alias("u0"), F.get("features", F.lit(1)).alias("u1")), but=("user",))


@query()
def als_factorization(spark, sf_dir):
    r = _ratings(spark, sf_dir).select(F.col("item").cast("int").alias("item"), F.col("user").cast("int").alias("user"), F.col("r").cast("float").alias("r"))
    model = Z.factorize(r, "user", "item", "r")
    return model.transform(r).agg(Z.rmse(F.col("r"), F.col("prediction")).alias("rmse"))


_DAILY = "d AS (SELECT o_orderstatus AS s, date_trunc('day', o_orderdate) AS t, sum(o_totalprice)/1e6 AS v FROM orders GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.date_trunc("day", "o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1e6).alias("v"))


@query(f"WITH {_DAILY}, x AS (SELECT s, v, lag(v) OVER (PARTITION BY s ORDER BY t) AS p FROM d) SELECT s, round(sum(v*p)/sum(p*p), 6) + 0.0::DOUBLE AS phi FROM x WHERE p IS NOT NULL GROUP BY s")
def arima_ar1(spark, sf_dir):
    return rounded(A.arima(_daily(spark, sf_dir), ["s"], "t", "v", 1).select("s", F.get("phi", F.lit(0)).alias("phi")))


@query()
def arima_111(spark, sf_dir):
    return A.arima(_daily(spark, sf_dir), ["s"], "t", "v", 1, 1, 1)


@query(f"WITH {_DAILY}, x AS (SELECT s, t, v - lag(v) OVER (PARTITION BY s ORDER BY t) AS a FROM d) SELECT s, t, round(a - lag(a) OVER (PARTITION BY s ORDER BY t), 9) + 0.0::DOUBLE AS diff FROM x")
def differencing(spark, sf_dir):
    return rounded(P.differenced(_daily(spark, sf_dir), "v", "t", ["s"], 2).select("s", "t", "diff"), 9)


@query(f"WITH {_DAILY}, x AS (SELECT s, t, lag(v) OVER w AS lag1, lag(v, 2) OVER w AS lag2 FROM d WINDOW w AS (PARTITION BY s ORDER BY t)) SELECT s, t, round(lag1, 9) + 0.0::DOUBLE AS lag1, round(lag2, 9) + 0.0::DOUBLE AS lag2 FROM x WHERE lag2 IS NOT NULL")
def lag_matrix(spark, sf_dir):
    return rounded(P.lag_matrix(_daily(spark, sf_dir), "v", "t", ["s"], 2).select("s", "t", "lag1", "lag2"), 9)


@query(f"WITH {_DAILY} SELECT s, t, round(avg(v) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) + 0.0::DOUBLE AS average FROM d")
def moving_average(spark, sf_dir):
    return rounded(P.moving_average(_daily(spark, sf_dir), "v", "t", ["s"]).select("s", "t", "average"), 9)


@query()
def random_forest(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_quantity", "l_discount", "l_tax")
    m = T.random_forest_classifier(df, ["l_quantity", "l_discount", "l_tax"], "y")
    return spark.createDataFrame(m.importances(), "name string, importance double")


@query()
def gradient_boosting(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax")
    m = T.gradient_boosting_regressor(df, ["l_quantity", "l_discount", "l_tax"], "y")
    return m.predict(df).agg(F.sqrt(F.avg(M.se("y", "prediction"))).alias("rmse"))


@query()
def graph_form_lasso(spark, sf_dir):
    df = _regression(spark, sf_dir).select((F.col("l_quantity") / 50).alias("a"), F.col("l_discount").alias("b"), (F.col("y") / 100).alias("o"))
    x = G.solve(df, ["a", "b"], {"h": "square"}, {"h": "abs", "c": 1.0}, offset="o")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["a", "b"], x, strict=True)], "name string, value double")


# -- convex functions ------------------------------------------------------------------------------------------------

_GRID = "g AS (SELECT DISTINCT l_discount * 40 - 2 AS v FROM lineitem)"
_PROX_SQL = {
    "abs": "greatest(v-.5,0)-greatest(-v-.5,0)", "huber": "CASE WHEN abs(v)<1.5 THEN v*2/3 ELSE v-.5*sign(v) END", "identity": "v-.5", "indbox01": "least(greatest(v,0),1)", "indeq0": "0.0::DOUBLE",
    "indge0": "greatest(v,0)", "indle0": "least(v,0)", "maxneg0": "CASE WHEN v>=0 THEN v WHEN v<=-.5 THEN v+.5 ELSE 0 END", "maxpos0": "CASE WHEN v<=0 THEN v WHEN v>=.5 THEN v-.5 ELSE 0 END",
    "neglog": "(v+sqrt(v*v+2))/2", "square": "v*2/3", "zero": "v",
}


@query(f"WITH {_GRID} SELECT round(v, 6) + 0.0::DOUBLE AS v, " + ", ".join(_r(e, k) for k, e in _PROX_SQL.items()) + " FROM g")
def proximal_operators(spark, sf_dir):
    grid = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 40 - 2).alias("v")).distinct()
    return rounded(grid.select("v", *[X.prox(k, F.col("v"), 2.0).alias(k) for k in _PROX_SQL]))


@query(f"WITH {_GRID} SELECT round(v, 6) + 0.0::DOUBLE AS v, " + ", ".join(_r(e, k) for k, e in {"abs": "abs(v)", "exp": "exp(v)", "huber": "CASE WHEN abs(v)<1 THEN v*v/2 ELSE abs(v)-.5 END", "logistic": "ln(1+exp(v))", "maxneg0": "greatest(-v,0)", "maxpos0": "greatest(v,0)", "negentr": "CASE WHEN v<=0 THEN 0 ELSE v*ln(CASE WHEN v<=0 THEN 1 ELSE v END) END", "square": "v*v/2"}.items()) + " FROM g")
def convex_values(spark, sf_dir):
    grid = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 40 - 2).alias("v")).distinct()
    return rounded(grid.select("v", *[X.value(k, F.col("v")).alias(k) for k in ("abs", "exp", "huber", "logistic", "maxneg0", "maxpos0", "negentr", "square")]))


@query()
def proximal_iterated(spark, sf_dir):
    grid = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 40 - 2).alias("v")).distinct()
    return grid.select("v", *[X.prox(k, F.col("v"), 2.0).alias(k) for k in ("exp", "logistic", "negentr", "recipr")])


# -- preparation -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def label_index(spark, sf_dir):
    return P.label_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("WITH f AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, code::BIGINT AS code FROM orders JOIN f USING (o_orderpriority)")
def first_seen_index(spark, sf_dir):
    return P.first_seen_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "code").select("o_orderkey", "code")


@query("SELECT l_orderkey, l_linenumber, (l_linestatus='O')::INT AS l_linestatus_O, (l_returnflag='N')::INT AS l_returnflag_N, (l_returnflag='R')::INT AS l_returnflag_R FROM lineitem")
def one_hot(spark, sf_dir):
    df = P.one_hot(table(spark, sf_dir, "lineitem"), "l_linestatus", ["F", "O"])
    return P.one_hot(df, "l_returnflag", ["A", "N", "R"]).select("l_orderkey", "l_linenumber", "l_linestatus_O", "l_returnflag_N", "l_returnflag_R")


@query("WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT l_suppkey, n, CASE WHEN n < 600 THEN 'RARE' ELSE l_suppkey::VARCHAR END AS freq_level FROM c), y AS (SELECT *, sum(n) OVER (PARTITION BY freq_level) / sum(n) OVER () AS f FROM x) SELECT l_orderkey, l_linenumber, freq_level, round(f, 9) + 0.0::DOUBLE AS freq FROM lineitem JOIN y USING (l_suppkey)")
def frequency_encoding(spark, sf_dir):
    df = P.frequency_encode(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", rare=600)
    return rounded(df.select("l_orderkey", "l_linenumber", "freq_level", "freq"), 9)


@query("WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, avg(l_tax) AS m, stddev_samp(l_tax) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, " + _r("(l_quantity-a)/(b-a)", "l_quantity") + ", " + _r("(l_tax-m)/d", "l_tax") + " FROM lineitem, s")
def scaling(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(P.scaled(P.scaled(df, ["l_quantity"]), ["l_tax"], "zscore").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS m FROM orders) SELECT o_orderkey, k >= m - floor(0.2 * m)::BIGINT AS is_valid, floor(k * 5 / m)::INT AS fold FROM r")
def splits_and_folds(spark, sf_dir):
    df = P.head_tail_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)
    return P.contiguous_folds(df, "o_orderkey", 5)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, (o_orderstatus IN ('F','O'))::INT AS settled FROM orders WHERE o_totalprice IS NOT NULL")
def derived_labels(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").dropna(subset=["o_totalprice"]).select("o_orderkey", F.when(price > 200000, "high").when(price > 100000, "middle").otherwise("low").alias("band"), F.col("o_orderstatus").isin("F", "O").cast("int").alias("settled"))


# -- look-ups --------------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') "
    "SELECT e.event_id, e.user_id, p.value AS latest_value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts"
)
def as_of_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return P.latest_before(left, right, "user_id", "ts", ["value"]).select("event_id", "user_id", "latest_value")


@query("SELECT event_id, round(sum(value) OVER w, 6) + 0.0::DOUBLE AS last_sum, count(value) OVER w AS last_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def last_rows(spark, sf_dir):
    return rounded(P.last_rows(table(spark, sf_dir, "events"), "user_id", "ts", "value", 5).select("event_id", "last_sum", "last_n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def first_of_each(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return P.first_of_each(df, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, round(c_acctbal / max(c_acctbal) OVER (PARTITION BY c_nationkey), 9) + 0.0::DOUBLE AS share FROM customer")
def share_of_group_max(spark, sf_dir):
    return rounded(P.share_of_group_max(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", "share"), 9)


@query("SELECT part_key, source FROM (SELECT p_partkey AS part_key, 'unused' AS source FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT DISTINCT l_partkey, 'used' FROM lineitem WHERE l_quantity > 45)")
def used_and_unused(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("part_key")).distinct()
    unused = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key")).join(used, "part_key", "left_anti")
    return unused.withColumn("source", F.lit("unused")).unionByName(used.withColumn("source", F.lit("used")))


@query("SELECT row, col, round(value, 6) + 0.0::DOUBLE AS value FROM (SELECT l_orderkey * 8 + l_linenumber AS row, unnest([0, 1]) AS col, unnest([l_discount, l_tax]) AS value FROM lineitem) WHERE value <> 0")
def sparse_triples(spark, sf_dir):
    from ..sources.readers import triples

    df = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return rounded(triples(df, ["l_discount", "l_tax"], "key"))


# -- reports, dictionaries, samples ----------------------------------------------------------------------------------


@query(
    "WITH x AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem), s AS (SELECT label, sum(i)::DOUBLE AS i, sum(c)::DOUBLE AS c, sum(r)::DOUBLE AS r FROM "
    "(SELECT y AS label, 1 AS i, 0 AS c, (y = p)::INT AS r FROM x UNION ALL SELECT p, 0, 1, 0 FROM x) GROUP BY label), m AS (SELECT label, i::BIGINT AS support, r / c AS precision, r / i AS recall, 2 * r / (i + c) AS f1 FROM s) "
    "SELECT label, support, " + ", ".join(_r(c, c) for c in ("precision", "recall", "f1")) + " FROM m UNION ALL SELECT NULL, sum(support)::BIGINT, " + ", ".join(_r(f"sum({c} * support) / sum(support)", c) for c in ("precision", "recall", "f1")) + " FROM m"
)
def class_report(spark, sf_dir):
    q = F.col("l_quantity")
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("p"))
    return rounded(M.class_report(df, "y", "p"))


@query(
    "WITH w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code FROM (SELECT DISTINCT l_linestatus AS word FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem)) "
    "SELECT l_orderkey, l_linenumber, a.code::BIGINT AS l_linestatus_code, b.code::BIGINT AS l_returnflag_code FROM lineitem JOIN w a ON l_linestatus = a.word JOIN w b ON l_returnflag = b.word"
)
def shared_dictionary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    return P.shared_index(df, ["l_linestatus", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_linestatus_code", "l_returnflag_code")


@query("WITH o AS (SELECT l_orderkey, l_linenumber, 1.5 + l_discount * 10 AS a, 2.0 + l_tax * 10 AS b, 3.0 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(_r(f"(1/{c}) / (1/a + 1/b + 1/c)", f"p_{c}", 9) for c in "abc") + " FROM o")
def odds_to_probabilities(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1.5 + F.col("l_discount") * 10).alias("a"), (2.0 + F.col("l_tax") * 10).alias("b"), F.lit(3.0).alias("c"))
    return rounded(P.odds_to_probabilities(df, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "p_a", "p_b", "p_c"), 9)


@query(
    "WITH e AS (SELECT event_id, ts, unnest([0, 1]) AS side, unnest([user_id, (user_id * 7 + 3) % 97]) AS party, unnest([value, -value]) AS v FROM events), "
    "x AS (SELECT event_id, side, sum(v) OVER w AS s, count(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY party ORDER BY ts, event_id, side ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) "
    "SELECT event_id, round(max(s) FILTER (side = 0), 6) + 0.0::DOUBLE AS home_sum, max(n) FILTER (side = 0) AS home_n, round(max(s) FILTER (side = 1), 6) + 0.0::DOUBLE AS away_sum, max(n) FILTER (side = 1) AS away_n FROM x GROUP BY event_id"
)
def last_of_either_side(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("home"), ((F.col("user_id") * 7 + 3) % 97).alias("away"), F.col("value").alias("v"), (-F.col("value")).alias("w"))
    return rounded(P.last_of_either_side(df, ["home", "away"], ["v", "w"], "ts", "event_id", 4))


@query(f"WITH {_DAILY} SELECT s, t, round(v, 3) + 0.0::DOUBLE AS value FROM d")
def undifferencing(spark, sf_dir):
    series = P.differenced(_daily(spark, sf_dir), "v", "t", ["s"])
    return rounded(P.undifferenced(series, "diff", F.col("v"), "t", ["s"]).select("s", "t", "value"), 3)


@query("SELECT vec_id, 1.0::DOUBLE AS length FROM embeddings")
def normalized_rows(spark, sf_dir):
    df = P.normalized_rows(_vectors(spark, sf_dir), "x")
    return rounded(df.select("vec_id", F.sqrt(F.aggregate("normal", F.lit(0.0), lambda s, x: s + x * x)).alias("length")), 9)


@query("SELECT o_orderpriority, count(*) AS n, floor(0.2 * count(*))::BIGINT AS valid FROM orders GROUP BY 1")
def stratified_split(spark, sf_dir):
    df = P.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"))


# -- fitted models against their own conditions of optimality --------------------------------------------------------


def _flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))


def _violations(spark, df, features, models, chance) -> DataFrame:
    """How far each (name, model, lambda, alpha) is from its conditions of optimality, a row: a multiple of the number of rows, rounded."""
    out = []
    for name, m, lam, alpha in models:
        rest = F.col("y") - chance(m)
        row = df.agg(F.count("*").alias("n"), F.sum(rest).alias("r"), *[F.sum(rest * F.col(c)).alias(c) for c in features]).first()
        gaps = [abs(row["r"])]
        for c, b in zip(features, m.coef):
            g = row[c] - lam * (1 - alpha) * b
            gaps.append(abs(g - lam * alpha * (1 if b > 0 else -1)) if abs(b) > 1e-9 else max(0.0, abs(g) - lam * alpha))
        out.append((*name, round(float(max(gaps) / row["n"]), 5) + 0.0))
    return spark.createDataFrame(out, "alpha_idx int, lambda_idx int, violation double")


@query("SELECT a.i::INT AS alpha_idx, l.i::INT AS lambda_idx, 0.0::DOUBLE AS violation FROM range(2) a(i), range(4) l(i)")
def logistic_path_optimality(spark, sf_dir):
    df = _flags(spark, sf_dir)
    fit = L.ElasticNetPath(n_lambdas=4, alphas=[0.5, 1.0], n_folds=3, lambda_min_ratio=1e-3, family="logistic").fit(df, ["a", "b", "c"], "y")
    rows = [((r["alpha_idx"], r["lambda_idx"]), fit.models[r["alpha_idx"], r["lambda_idx"]], r["lambda"], r["alpha"]) for r in fit.path]
    return _violations(spark, df, ["a", "b", "c"], rows, lambda m: 1 / (1 + F.exp(-S.linear_sum(m.features, m.coef, m.intercept))))


@query("SELECT a.i::INT AS alpha_idx, l.i::INT AS lambda_idx, 0.0::DOUBLE AS violation FROM range(3) a(i), range(4) l(i)")
def elastic_net_optimality(spark, sf_dir):
    df = _regression(spark, sf_dir).select("y", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))
    fit = L.ElasticNetPath(n_lambdas=4, n_alphas=3, lambda_min_ratio=1e-3).fit(df, ["a", "b", "c"], "y")
    rows = [((r["alpha_idx"], r["lambda_idx"]), fit.models[r["alpha_idx"], r["lambda_idx"]], r["lambda"], r["alpha"]) for r in fit.path]
    return _violations(spark, df, ["a", "b", "c"], rows, lambda m: S.linear_sum(m.features, m.coef, m.intercept))


@query("SELECT 0::INT AS alpha_idx, 0::INT AS lambda_idx, 0.0::DOUBLE AS violation")
def logistic_regression_optimality(spark, sf_dir):
    df = _flags(spark, sf_dir)
    m = L.logistic_regression(df, ["a", "b", "c"], "y")
    return _violations(spark, df, ["a", "b", "c"], [((0, 0), m, 1.0, 0.0)], lambda m: m.probability())


def _products(df: DataFrame, k: int, scale, centre: bool) -> DataFrame:
    """(i, j, value) of the sums of products of the columns c0, c1, ..., less their means if asked for, over ``scale`` of both."""
    cells = []
    for i in range(k):
        for j in range(i, k):
            product = F.covar_samp(f"c{i}", f"c{j}") if centre else F.sum(F.col(f"c{i}") * F.col(f"c{j}"))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (product / float(scale[i] * scale[j])).alias("value")))
    return rounded(df.agg(F.array(*cells).alias("a")).select(F.inline("a")), 5)


_IDENTITY = "SELECT i.i::INT AS i, j.j::INT AS j, (i.i = j.j)::INT::DOUBLE AS value FROM range(4) i(i), range(4) j(j) WHERE i.i <= j.j"


@query(_IDENTITY)
def pca_orthogonality(spark, sf_dir):
    df, names = D.exploded_vector(_vectors(spark, sf_dir), "x", 64)
    m = D.pca(df, names, 4)
    return _products(m.transform(df), 4, m.explained_variance**0.5, True)


@query(_IDENTITY)
def svd_orthogonality(spark, sf_dir):
    df, names = D.exploded_vector(_vectors(spark, sf_dir), "x", 64)
    m = D.truncated_svd(df, names, 4)
    return _products(m.transform(df), 4, m.singular_values, False)


@query("SELECT l.i::INT AS label, 0.0::DOUBLE AS shift FROM range(3) l(i)")
def kmeans_fixed_point(spark, sf_dir):
    """How far each centre is from the mean of the rows nearest to it, after all steps."""
    import numpy as np

    m = K.kmeans(_vectors(spark, sf_dir), "x", 3, seed=1, tol=1e-12)
    new, _, _ = K.lloyd_step(_vectors(spark, sf_dir), "x", m.centres)
    return spark.createDataFrame([(k, round(float(np.abs(a - b).max()), 6) + 0.0) for k, (a, b) in enumerate(zip(new, m.centres, strict=True))], "label int, shift double")


@query(f"WITH {_RATINGS} SELECT count(DISTINCT \"user\") AS users, 0::BIGINT AS violated FROM r")
def als_normal_equations(spark, sf_dir):
    """Of the side that is solved last: sum (u'v - r) u + lam n v is zero for each of its factors v."""
    r = _ratings(spark, sf_dir).select(F.col("item").cast("int").alias("item"), F.col("user").cast("int").alias("user"), F.col("r").cast("float").alias("r"))
    m = Z.factorize(r, "item", "user", "r", rank=4, lam=0.1)
    last, other = m.userFactors, m.itemFactors
    if m._java_obj is not None and m.getUserCol() == "item":
        last, other = other, last
    u = other.select(F.col("id").alias("item"), F.col("features").alias("u"))
    v = last.select(F.col("id").alias("user"), F.col("features").alias("v"))
    joined = r.join(u, "item").join(v, "user").withColumn("e", S.dot(F.col("u"), F.col("v")) - F.col("r"))
    gaps = joined.groupBy("user").agg(*[F.abs(F.sum(F.col("e") * F.get("u", F.lit(k))) + 0.1 * F.count("*") * F.first(F.get("v", F.lit(k)))).alias(f"g{k}") for k in range(4)], F.sum(F.abs(F.col("r"))).alias("size"))
    return gaps.agg(F.count("*").alias("users"), F.count_if(F.greatest(*[F.col(f"g{k}") for k in range(4)]) > 1e-3 * (1 + F.col("size"))).alias("violated"))


@query(
    "WITH x AS (SELECT l_quantity / 50 AS a, l_discount AS b, l_extendedprice / 100000 AS o FROM lineitem), s AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*o) AS ao, sum(b*o) AS bo FROM x), "
    "r AS (SELECT ((ao-1)*bb - (bo-1)*ab) / (aa*bb - ab*ab) AS a, ((bo-1)*aa - (ao-1)*ab) / (aa*bb - ab*ab) AS b FROM s) SELECT 'a' AS name, round(a, 3) + 0.0::DOUBLE AS value FROM r UNION ALL SELECT 'b', round(b, 3) + 0.0 FROM r"
)
def graph_form_closed_form(spark, sf_dir):
    """Both coefficients are positive here, so the lasso's solution is that of a linear system."""
    df = _regression(spark, sf_dir).select((F.col("l_quantity") / 50).alias("a"), F.col("l_discount").alias("b"), (F.col("y") / 100).alias("o"))
    x = G.solve(df, ["a", "b"], {"h": "square"}, {"h": "abs", "c": 1.0}, offset="o", tol=1e-7)
    return spark.createDataFrame([(n, round(float(v), 3)) for n, v in zip(["a", "b"], x, strict=True)], "name string, value double")


@query(f"WITH {_GRID} SELECT round(v, 6) + 0.0::DOUBLE AS v, " + ", ".join(f"0.0::DOUBLE AS {k}" for k in ("exp", "logistic", "negentr", "recipr")) + " FROM g")
def proximal_stationarity(spark, sf_dir):
    """h'(x) + rho (x - v) at x = prox(v), which is zero."""
    grid = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 40 - 2).alias("v")).distinct()
    slope = {"exp": F.exp, "logistic": lambda x: 1 / (1 + F.exp(-x)), "negentr": lambda x: F.log(x) + 1, "recipr": lambda x: -1 / (x * x)}
    found = grid.select("v", *[X.prox(k, F.col("v"), 2.0).alias(k) for k in slope])
    return rounded(found.select(F.round("v", 6).alias("v"), *[F.round(f(F.col(k)) + 2.0 * (F.col(k) - F.col("v")), 5).alias(k) for k, f in slope.items()]))


_SLOPES_SQL = {
    "abs": "CASE WHEN x=0 THEN greatest(-1, least(1, v)) ELSE sign(x) END", "exp": "exp(x)", "huber": "greatest(-1, least(1, x))", "identity": "1", "indbox01": "CASE WHEN x<=0 THEN least(v, 0) WHEN x>=1 THEN greatest(v, 0) ELSE 0 END",
    "indeq0": "v", "indge0": "CASE WHEN x<=0 THEN least(v, 0) ELSE 0 END", "indle0": "CASE WHEN x>=0 THEN greatest(v, 0) ELSE 0 END", "logistic": "1/(1+exp(-x))",
    "maxneg0": "CASE WHEN x<0 THEN -1 WHEN x>0 THEN 0 ELSE greatest(-1, least(0, v)) END", "maxpos0": "CASE WHEN x<0 THEN 0 WHEN x>0 THEN 1 ELSE greatest(0, least(1, v)) END", "square": "x", "zero": "0",
    "negentr": "1 + ln(abs(x) + 1)", "neglog": "-1/(abs(x) + 1)", "recipr": "-1/((abs(x) + 1) * (abs(x) + 1))",
}


@query("WITH g AS (SELECT DISTINCT (l_linenumber - 2)::DOUBLE AS x, l_quantity / 16 - 1.5 AS v FROM lineitem) SELECT x, v, " + ", ".join(_r(e, k) for k, e in _SLOPES_SQL.items()) + " FROM g")
def subgradient_projections(spark, sf_dir):
    """Of all sixteen functions; those of positive numbers only are taken at abs(x) + 1."""
    grid = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 2).cast("double").alias("x"), (F.col("l_quantity") / 16 - 1.5).alias("v")).distinct()
    at = lambda k: F.abs("x") + 1 if k in ("negentr", "neglog", "recipr") else F.col("x")
    return rounded(grid.select("x", "v", *[X.subgradient_projection(k, F.col("v"), at(k)).alias(k) for k in _SLOPES_SQL]), but=("x", "v"))


# -- estimators, selection, boosting, sparse and row-wise problems ---------------------------------------------------

from ..operators import boosting as B  # noqa: E402
from ..operators import estimators as E  # noqa: E402
from ..operators import krylov as C  # noqa: E402
from .stored import discard, shared_folder, stored  # noqa: E402


@query(_NORMAL.format(lam=50).split("SELECT 'l_quantity'")[0] + "SELECT l_orderkey, l_linenumber, round(my - b1*mx - b2*mz + b1*l_quantity + b2*l_discount, 4) + 0.0::DOUBLE AS prediction FROM lineitem, b")
def saved_pipeline_predictions(spark, sf_dir):
    """Ridge fitted in a pipeline, saved to the shared folder, loaded and applied."""
    import uuid

    from pyspark.ml import Pipeline, PipelineModel

    df = _regression(spark, sf_dir)
    path = f"{shared_folder(spark)}/quern-model-{uuid.uuid4().hex}"
    Pipeline(stages=[E.ElasticNet(inputCols=["l_quantity", "l_discount"], labelCol="y", lam=50.0, alpha=0.0)]).fit(df).save(path)
    return rounded(PipelineModel.load(path).transform(df).select("l_orderkey", "l_linenumber", "prediction"), 4)


_FOLDS_SQL = (
    "WITH x AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_orderkey % 3 AS fold FROM lineitem), l AS (SELECT i - 1 AS map, lam FROM (VALUES (1, 0.0::DOUBLE), (2, 1e6), (3, 1e7)) v(i, lam)), "
    "s AS (SELECT k.fold, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy FROM x, (SELECT DISTINCT fold FROM x) k WHERE x.fold <> k.fold GROUP BY k.fold), "
    "m AS (SELECT map, lam, fold, xy / (xx + lam) AS b, my - xy / (xx + lam) * mx AS a FROM s, l), "
    "e AS (SELECT map, lam, m.fold, sqrt(avg((y - a - b * x) * (y - a - b * x))) AS error FROM m JOIN x ON x.fold = m.fold GROUP BY map, lam, m.fold) "
)


def _folded(spark, sf_dir):
    return _regression(spark, sf_dir).select(F.col("l_quantity").alias("x"), "y", (F.col("l_orderkey") % 3).cast("int").alias("fold"))


@query(_FOLDS_SQL + "SELECT map::INT AS map, fold::INT AS fold, round(error, 5) + 0.0::DOUBLE AS error FROM e")
def cross_validation_errors(spark, sf_dir):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import ParamGridBuilder

    stage = E.ElasticNet(inputCols=["x"], labelCol="y", alpha=0.0)
    grid = ParamGridBuilder().addGrid(stage.lam, [0.0, 1e6, 1e7]).build()
    _, errors = E.cross_validate(_folded(spark, sf_dir), stage, grid, RegressionEvaluator(labelCol="y"), "fold", ["x", "y"])
    return rounded(errors.select("map", "fold", "error"), 5)


@query(_FOLDS_SQL + ", c AS (SELECT fold, first(lam ORDER BY error, map) AS lam FROM e GROUP BY fold), w AS (SELECT var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy FROM x) SELECT round(avg(lam), 3) + 0.0::DOUBLE AS lambda, round(any_value(xy) / (any_value(xx) + avg(lam)), 6) + 0.0::DOUBLE AS coef FROM c, w")
def elastic_net_second_pass(spark, sf_dir):
    """The model on all rows at the mean of the folds' best lambdas."""
    fit = L.ElasticNetPath(lambdas=[0.0, 1e6, 1e7], alphas=[0.0]).fit(_folded(spark, sf_dir), ["x"], "y", fold="fold")
    return fit.refit_frame(spark).select((F.round("lambda", 3) + F.lit(0.0)).alias("lambda"), (F.round(F.get("coef", F.lit(0)), 6) + F.lit(0.0)).alias("coef"))


@query(
    "WITH x AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), t AS (SELECT avg(y) AS m, count(*)::DOUBLE AS n FROM x), g AS (SELECT x, sum(m - y) AS g, count(*)::DOUBLE AS h FROM x, t GROUP BY x), "
    "c AS (SELECT x AS threshold, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h FROM g WINDOW w AS (ORDER BY x)), "
    "s AS (SELECT threshold, gl, hl, g - gl AS gr, h - hl AS hr, 0.5 * (gl*gl/(hl+1) + (g-gl)*(g-gl)/(h-hl+1) - g*g/(h+1)) AS gain FROM c WHERE hl >= 1 AND h - hl >= 1 ORDER BY gain DESC LIMIT 1) "
    "SELECT threshold, round(gain, 2) + 0.0::DOUBLE AS gain, round(-gl/(hl+1), 6) + 0.0::DOUBLE AS below, round(-gr/(hr+1), 6) + 0.0::DOUBLE AS above FROM s"
)
def boosted_stump(spark, sf_dir):
    """The first split of squared loss at full rate is the best of all cuts."""
    df = _regression(spark, sf_dir).select(F.col("l_quantity").alias("x"), "y")
    tree = B.boost(df, ["x"], "y", n_rounds=1, learning_rate=1.0, max_depth=1, max_bins=255).rounds[0][0]
    return spark.createDataFrame([(tree.threshold[0], round(tree.gain[0], 2), round(tree.value[1], 6) + 0.0, round(tree.value[2], 6) + 0.0)], "threshold double, gain double, below double, above double")


def _three_classes(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", 0.0).when(F.col("l_returnflag") == "A", 1.0).otherwise(2.0)
    return table(spark, sf_dir, "lineitem").select(kind.alias("y"), "l_quantity", "l_discount", "l_tax", F.year("l_shipdate").cast("double").alias("year"), (F.col("l_orderkey") % 5 == 0).alias("held"))


@query("SELECT i::INT AS round, true AS falls, 0.0::DOUBLE AS gap FROM range(1, 9) r(i)")
def softmax_boosting_history(spark, sf_dir):
    """Losses after each round of three classes: they fall, and equal those of the chances that the rounds so far give to the rows."""
    df = _three_classes(spark, sf_dir)
    m = B.boost(df, ["l_quantity", "l_discount", "l_tax", "year"], "y", "softmax", n_rounds=8, learning_rate=0.3)
    rows = stored(B.merged(df.drop("held").withColumn("n", F.lit(1)), "n"), "rows")
    out, before = [], float("inf")
    for r, train, _ in m.history:
        own = F.get("probability", F.col("y").cast("int"))
        again = m.predict(rows, rounds=r).agg(-F.sum(F.log(own) * F.col("n")) / F.sum("n")).first()[0]
        out.append((r, train < before, round(abs(train - again), 6) + 0.0))
        before = train
    discard(rows)
    return spark.createDataFrame(out, "round int, falls boolean, gap double")


@query()
def boosting_gains_by_depth(spark, sf_dir):
    m = B.boost(_three_classes(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "year"], "y", "softmax", n_rounds=10, valid="held", patience=3)
    return rounded(B.importance_by_depth(m.nodes(spark)))


@query()
def boosting_interactions(spark, sf_dir):
    m = B.boost(_three_classes(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "year"], "y", "softmax", n_rounds=10)
    return rounded(B.interactions(m.nodes(spark), 2))


_TWO = "SELECT 'a' AS name, round((ao*bb - bo*ab) / (aa*bb - ab*ab), 4) + 0.0::DOUBLE AS value FROM s UNION ALL SELECT 'b', round((bo*aa - ao*ab) / (aa*bb - ab*ab), 4) + 0.0 FROM s"


@query("WITH x AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 100000 AS o, 1 + l_tax * 10 AS w FROM lineitem), s AS (SELECT sum(w*a*a) AS aa, sum(w*a*b) AS ab, sum(w*b*b) AS bb, sum(w*a*o) AS ao, sum(w*b*o) AS bo FROM x) " + _TWO)
def graph_form_row_weights(spark, sf_dir):
    """A function for each row: squares weighted by a column."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 100000).alias("o"), (1 + F.col("l_tax") * 10).alias("w"))
    x = G.solve(df, ["a", "b"], {"h": "square", "c": "w"}, {"h": "zero"}, offset="o", tol=1e-8)
    return spark.createDataFrame([(n, round(float(v), 4) + 0.0) for n, v in zip(["a", "b"], x, strict=True)], "name string, value double")


@query("WITH x AS (SELECT (o_custkey % 3)::DOUBLE AS a, (o_orderkey % 4)::DOUBLE AS b, o_totalprice / 1e5 AS o FROM orders), s AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*o) AS ao, sum(b*o) AS bo FROM x) " + _TWO)
def sparse_least_squares(spark, sf_dir):
    """Conjugate gradients over the triples of two columns with zeros."""
    from ..sources.readers import triples

    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("a"), (F.col("o_orderkey") % 4).alias("b"), (F.col("o_totalprice") / 1e5).alias("value"))
    found = C.cgls(triples(df, ["a", "b"], "o_orderkey"), df.select(F.col("o_orderkey").alias("row"), "value"))
    return rounded(found.x.select(F.when(F.col("col") == 0, "a").otherwise("b").alias("name"), "value"), 4)


@query("SELECT i.i::INT AS i, j.j::INT AS j, (i.i = j.j)::INT::DOUBLE AS value FROM range(3) i(i), range(3) j(j) WHERE i.i <= j.j UNION ALL SELECT -1, k::INT, 1.0 FROM range(3) k(k) UNION ALL SELECT -2, k::INT, 0.0 FROM range(3) k(k)")
def svd_left_factors(spark, sf_dir):
    """U'U is the identity; row -1: the entry of largest size of each column of U is positive; row -2: X less U S V' is 0."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 1e5).alias("x0"), (F.col("o_custkey") % 7 / 3).alias("x1"), (F.col("o_orderkey") % 5 / 2).alias("x2"))
    fitted = D.truncated_svd(df, ["x0", "x1", "x2"], 3)
    u, turned = D.left_factors(df, "key", fitted)
    products = _products(u.toDF("key", "c0", "c1", "c2"), 3, [1.0] * 3, False)
    both = u.join(df, "key")
    tops = [F.round(F.max_by(F.signum(f"u{i}"), F.abs(f"u{i}")), 6).alias(f"a{i}") for i in range(3)]
    gaps = [F.round(F.max(F.abs(F.col(f"x{j}") - S.linear_sum(["u0", "u1", "u2"], turned.components[:, j] * turned.singular_values))), 6).alias(f"b{j}") for j in range(3)]
    row = both.agg(*tops, *gaps).first()
    more = [(-1, i, float(row[f"a{i}"])) for i in range(3)] + [(-2, i, float(row[f"b{i}"]) + 0.0) for i in range(3)]
    return products.unionByName(spark.createDataFrame(more, "i int, j int, value double"))


@query(
    "WITH e AS (SELECT event_id, ts, user_id % 20 AS home, (user_id * 7 + 3) % 23 AS away, value AS v, -value AS w FROM events), t AS (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi, CASE WHEN home <= away THEN v ELSE w END AS v0, CASE WHEN home <= away THEN w ELSE v END AS v1 FROM e), "
    "x AS (SELECT event_id, home <= away AS f, sum(v0) OVER q AS s0, sum(v1) OVER q AS s1, count(*) OVER q AS n FROM t WINDOW q AS (PARTITION BY lo, hi ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) "
    "SELECT event_id, round(CASE WHEN f THEN s0 ELSE s1 END, 6) + 0.0::DOUBLE AS home_sum, round(CASE WHEN f THEN s1 ELSE s0 END, 6) + 0.0::DOUBLE AS away_sum, n FROM x"
)
def last_against_each_other(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("home"), ((F.col("user_id") * 7 + 3) % 23).alias("away"), F.col("value").alias("v"), (-F.col("value")).alias("w"))
    return rounded(P.last_against_each_other(df, ["home", "away"], ["v", "w"], "ts", "event_id", 3))


@query("WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / d, 6) + 0.0::DOUBLE AS l_extendedprice FROM lineitem, s WHERE l_orderkey % 5 = 0")
def standardized_by_training_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    _, held = P.standardized(df.where("l_orderkey % 5 <> 0"), [df.where("l_orderkey % 5 = 0")], ["l_extendedprice"])
    return rounded(held)


@query("SELECT name, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_returnflag")) + ")")
def distinct_values(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey", "l_returnflag"])


@query("SELECT o_orderkey, strftime(TIMESTAMP '1990-01-01' + to_seconds(o_orderkey * 4001), '%Y-%m-%d %H:%M') AS at FROM orders")
def formatted_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.date_text(F.lit(631152000) + F.col("o_orderkey") * 4001, "yyyy-MM-dd HH:mm").alias("at"))


_AXES = (
    "r AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l0, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM m), v AS (SELECT *, b / sqrt(b * b + (l0 - a) * (l0 - a)) AS p, (l0 - a) / sqrt(b * b + (l0 - a) * (l0 - a)) AS q FROM r), "
    "s AS (SELECT *, CASE WHEN (abs(p) > abs(q) AND p < 0) OR (abs(q) >= abs(p) AND q < 0) THEN -1 ELSE 1 END AS g, CASE WHEN (abs(q) > abs(p) AND -q < 0) OR (abs(p) >= abs(q) AND p < 0) THEN -1 ELSE 1 END AS h FROM v) "
)


def _two_columns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("z"))


def _axes(spark, m, values) -> DataFrame:
    return spark.createDataFrame([(i, *(round(float(n), 5) + 0.0 for n in (value, *v))) for i, (value, v) in enumerate(zip(values, m.components, strict=True))], "axis int, value double, x double, z double")


_AXES_OUT = "SELECT 0 AS axis, round({0}, 5) + 0.0::DOUBLE AS value, round(g * p, 5) + 0.0::DOUBLE AS x, round(g * q, 5) + 0.0::DOUBLE AS z FROM s UNION ALL SELECT 1, round({1}, 5) + 0.0, round(h * -q, 5) + 0.0, round(h * p, 5) + 0.0 FROM s"


@query("WITH m AS (SELECT var_samp(l_quantity / 10) AS a, covar_samp(l_quantity / 10, l_extendedprice / 20000) AS b, var_samp(l_extendedprice / 20000) AS c FROM lineitem), " + _AXES + _AXES_OUT.format("l0", "l1"))
def pca_axes(spark, sf_dir):
    """Both components of two columns, the larger variance first, against the closed form."""
    m = D.pca(_two_columns(spark, sf_dir), ["x", "z"], 2)
    return _axes(spark, m, m.explained_variance)


@query("WITH m AS (SELECT avg(l_quantity * l_quantity / 100) AS a, avg(l_quantity / 10 * l_extendedprice / 20000) AS b, avg(l_extendedprice * l_extendedprice / 4e8) AS c FROM lineitem), " + _AXES + _AXES_OUT.format("l0", "l1"))
def svd_axes(spark, sf_dir):
    """Right singular vectors of two columns and the squared singular values a row."""
    df = _two_columns(spark, sf_dir)
    m = D.truncated_svd(df, ["x", "z"], 2)
    return _axes(spark, m, m.singular_values**2 / df.count())


@query("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS l FROM x) SELECT vec_id, (i - 1)::INT AS i, round(v[i] / l, 6) + 0.0::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM n)")
def normalized_entries(spark, sf_dir):
    df = P.normalized_rows(_vectors(spark, sf_dir), "x")
    return rounded(df.select("vec_id", F.posexplode("normal").alias("i", "value")))
