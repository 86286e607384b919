"""Model-quality metrics over columns of a DataFrame: point errors, ranks, AUC and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ll(actual, predicted) -> Column:
    """Element log-loss with the score clipped to [1e-15, 1 - 1e-15]; an undefined value counts as 0."""
    a, p = _c(actual).cast("double"), F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), _c(predicted).cast("double")))
    return F.nanvl(-(a * F.log(p) + (1 - a) * F.log(1 - p)), F.lit(0.0))


def se(actual, predicted) -> Column:
    return F.pow(_c(actual) - _c(predicted), 2)


def ae(actual, predicted) -> Column:
    return F.abs(_c(actual) - _c(predicted))


def sle(actual, predicted) -> Column:
    return F.pow(F.log1p(_c(actual).cast("double")) - F.log1p(_c(predicted).cast("double")), 2)


def point_metrics(actual, predicted) -> dict[str, Column]:
    """Aggregates; all of them share one pass."""
    return {
        "log_loss": F.avg(ll(actual, predicted)),
        "mse": F.avg(se(actual, predicted)),
        "rmse": F.sqrt(F.avg(se(actual, predicted))),
        "mae": F.avg(ae(actual, predicted)),
        "msle": F.avg(sle(actual, predicted)),
        "rmsle": F.sqrt(F.avg(sle(actual, predicted))),
        "ce": F.avg((_c(actual) != _c(predicted)).cast("double")),
    }


def running_sums(df: DataFrame, key: str, sums: dict[str, str], order: str = "asc") -> DataFrame:
    """``df`` (one row for each ``key``) with exclusive running sums, named by ``sums`` {new: column}, in order of ``key``.

    Two passes: range partitions sum on their own, then each partition's offset is added,
    so no task sees more than its own range whatever the number of keys. Null keys come first.
    """
    from ..plans.stored import stored

    by = F.col(key).asc_nulls_first() if order == "asc" else F.col(key).desc_nulls_last()
    ranged = stored(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    parts = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select("__part", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])
    out = local.join(F.broadcast(offsets), "__part")
    for i, n in enumerate(sums):
        out = out.withColumn(n, F.col(n) + F.col(f"__o{i}"))
    return out.drop("__part", *[f"__o{i}" for i in range(len(sums))])


def tied_rank(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """(score, n, rank) for each distinct score: the average rank of its rows, ranks from 1 on."""
    groups = df.groupBy(score).agg(F.count("*").alias("n"))
    summed = running_sums(groups, score, {"__before": "n"})
    return summed.select(score, "n", (F.col("__before") + (F.col("n") + 1) / 2.0).alias(name))


def auc(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: the area under the ROC curve from tied ranks; positives are the rows with 1, null if a class is missing."""
    groups = df.groupBy(predicted).agg(F.count("*").alias("n"), F.sum((F.col(actual) == 1).cast("long")).alias("pos"))
    summed = running_sums(groups, predicted, {"__before": "n"})
    rank = F.col("__before") + (F.col("n") + 1) / 2.0
    total = summed.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return total.select(F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) < EPS, F.lit(0.0)).otherwise(top / bottom)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = F.lit(float(beta * beta))
    return _ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return F.nanvl(_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def confusion_matrices(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """One row for each distinct score p, rows with a score of p or more called positive: p, tp, tn, fp, fn, fpr, tpr, mcc, f1, f05, f2, acc.

    Labels are whole numbers; a label other than 0 and 1 counts by its value among those called positive and as a negative below the score.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(actual).cast("int")
    one = F.when(y == 1, w)
    sums = {"pos": one, "neg": F.when(y != 1, w), "by_label": w * y, "by_rest": w * (1 - y)}
    groups = df.groupBy(F.col(predicted).cast("double").alias("p")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()])
    total = groups.agg(F.sum("by_label").alias("all_pos"), F.sum("by_rest").alias("all_neg"))
    swept = running_sums(groups, "p", {"fn": "pos", "tn": "neg"}).join(F.broadcast(total))  # total is one row
    swept = swept.withColumn("tp", F.col("all_pos") - F.col("fn")).withColumn("fp", F.col("all_neg") - F.col("tn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return swept.select(
        "p", "tp", "tn", "fp", "fn",
        _ratio(fp, fp + tn).alias("fpr"), _ratio(tp, tp + fn).alias("tpr"), mcc(tp, tn, fp, fn).alias("mcc"),
        f_beta(tp, fp, fn, 1).alias("f1"), f_beta(tp, fp, fn, 0.5).alias("f05"), f_beta(tp, fp, fn, 2).alias("f2"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )


def best_thresholds(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """One row with the best value, at least 0, of each metric over the sweep: f05_opt, f1_opt, f2_opt, mcc_opt, acc_opt."""
    swept = confusion_matrices(df, actual, predicted, weight)
    return swept.agg(*[F.greatest(F.lit(0.0), F.max(k)).alias(f"{k}_opt") for k in ("f05", "f1", "f2", "mcc", "acc")])


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each label, and a row with a null label: the averages weighted by support. Undefined ratios are 0."""
    pairs = df.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select(F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("is"), F.lit(0).cast("long").alias("called"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("is"), F.col("n").alias("called"), F.lit(0).cast("long").alias("right")),
    )))
    sums = each.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("is", "called", "right")])
    precision, recall = (_ratio(F.col("right").cast("double"), F.col(c).cast("double")) for c in ("called", "is"))
    report = sums.select("label", F.col("is").alias("support"), precision.alias("precision"), recall.alias("recall"), f_beta(F.col("right").cast("double"), (F.col("called") - F.col("right")).cast("double"), (F.col("is") - F.col("right")).cast("double"), 1).alias("f1"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    kind = report.schema["label"].dataType.simpleString()
    return report.unionByName(report.agg(F.sum("support").alias("support"), mean("precision"), mean("recall"), mean("f1")).withColumn("label", F.lit(None).cast(kind)))
