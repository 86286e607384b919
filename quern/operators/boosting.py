"""Gradient boosting with second derivatives: one tree a class and round, for numbers, two classes or several.

Columns are cut into bins at quantiles once, and the rows are stored as bytes of bins. Each level of
all classes' trees is one job: tasks sum gradients by (class, node, column, bin), the sums of a (class, node, column) meet in one group,
which hands on its best split. A task holds sums, never rows, and the driver one split for each column.
Where equal rows are many they are stored as one with their weights summed, which changes no sum.
Missing values (null or NaN) have a bin of their own and go to the side where they gain more. What a row has reached so far is
stored with it every ``STORE_EVERY`` rounds; the rounds since then are read from their trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import discard, stored
from ..session import ship_package

#: Rounds after which rows are stored anew with what they have reached.
STORE_EVERY = 10
#: The bin of missing values; so at most 255 bins hold values.
MISSING = 255
LOSSES = ("squared", "logistic", "softmax")


@dataclass
class Tree:
    """Nodes in the order they were made: the root is 0, a leaf has feature -1. Rows go left if their value is at most the threshold."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, threshold: float, missing_left: bool, gain: float) -> tuple[int, int]:
        """Gives a leaf two leaves below; their numbers."""
        self.feature[node], self.bin[node], self.threshold[node], self.missing_left[node], self.gain[node] = feature, bin, threshold, missing_left, gain
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for column, x in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.parent, node), (self.depth, self.depth[node] + 1), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
                column.append(x)
        return self.left[node], self.right[node]

    def leaves(self, x: np.ndarray, bins: bool) -> np.ndarray:
        """The leaf of each row of ``x``: bytes of bins, or values with NaN where missing."""
        at = np.zeros(len(x), np.int64)
        feature, missing_left = np.array(self.feature), np.array(self.missing_left)
        cut = np.array(self.bin) if bins else np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        for _ in range(max(self.depth)):
            inner = np.flatnonzero(feature[at] >= 0)
            node = at[inner]
            v = x[inner, feature[node]]
            missing = v == MISSING if bins else np.isnan(v)
            at[inner] = np.where(np.where(missing, missing_left[node], v <= cut[node]), left[node], right[node])
        return at


def _margins(x: np.ndarray, start: np.ndarray, rounds: list[list[Tree]], bins: bool) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree.value)[tree.leaves(x, bins)]
    return out


def chances(margins: np.ndarray, loss: str) -> np.ndarray:
    if loss == "squared":
        return margins
    if loss == "logistic":
        return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(margins: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, curvature, loss) of each row: the first two by class."""
    if loss == "squared":
        rest = margins - y[:, None]
        return rest, np.ones_like(rest), rest[:, 0] ** 2
    p = chances(margins, loss)
    if loss == "logistic":
        t = y[:, None]
        return p - t, np.maximum(p * (1 - p), 1e-16), (np.maximum(margins, 0) - margins * t + np.log1p(np.exp(-np.abs(margins))))[:, 0]
    k = p.shape[1]
    own = y.astype(int)
    g = p.copy()
    g[np.arange(len(y)), own] -= 1
    return g, np.maximum(p * (1 - p) * k / (k - 1), 1e-16), -np.log(np.maximum(p[np.arange(len(y)), own], 1e-300))


def best_cut(sums: np.ndarray, ridge: float, gamma: float, least: float) -> tuple[float, int, bool, list[float]] | None:
    """(gain, last bin on the left, whether missing ones go left, sums of gradient and curvature left and right) of one column's bins; None without a gain.

    ``sums`` has gradient and curvature of each bin, the missing ones last. The first of equal cuts wins.
    """
    whole = sums.sum(axis=0)
    ahead = np.cumsum(sums[:-1], axis=0)
    best = None
    for missing_left in (True, False):
        left = ahead + (sums[-1] if missing_left else 0.0)
        right = whole - left
        gain = 0.5 * (left[:, 0] ** 2 / (left[:, 1] + ridge) + right[:, 0] ** 2 / (right[:, 1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)) - gamma
        gain = np.where((left[:, 1] >= least) & (right[:, 1] >= least), gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > 1e-12 and (best is None or gain[at] > best[0] + 1e-12):
            best = (float(gain[at]), at, missing_left, [float(v) for v in (*left[at], *right[at])])
    return best


@dataclass
class Boosted:
    """A fitted model: for each round a tree a class, and the losses after each round (None where nothing was held out)."""

    features: list[str]
    loss: str
    classes: list[float]
    base: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    def _applied(self, df: DataFrame, fn, kind: str):
        """A column from the rows' values as an array with NaN where missing, by batches."""
        ship_package(df.sparkSession)

        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(fn(_stacked(x, len(self.features)))))

        return run(_values(self.features))

    def predict(self, df: DataFrame, name: str = "prediction", probability: str | None = "probability", margin: str | None = None, rounds: int | None = None) -> DataFrame:
        """Adds the label or number, by the first ``rounds``; for classes also the array of chances, in the order of ``classes``."""
        base, used, loss = np.array(self.base), self.rounds[:rounds], self.loss
        out = df.withColumn("__margin", self._applied(df, lambda x: _margins(x, np.tile(base, (len(x), 1)), used, False), "array<double>"))
        m = F.col("__margin")
        if loss == "squared":
            out = out.withColumn(name, F.get(m, F.lit(0)))
        else:
            if loss == "logistic":
                one = 1 / (1 + F.exp(-F.get(m, F.lit(0))))
                p = F.array(1 - one, one)
            else:
                e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
                p = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))
            out = out.withColumn("__p", p)
            labels = F.array(*[F.lit(float(c)) for c in self.classes])
            out = out.withColumn(name, F.get(labels, F.array_position("__p", F.array_max("__p")).cast("int") - 1))
            out = out.withColumn(probability, F.col("__p")) if probability else out
            out = out.drop("__p")
        return (out.withColumn(margin, m) if margin else out).drop("__margin")

    def staged(self, df: DataFrame, key: str) -> DataFrame:
        """(key, round, margin) after each round, one row for each row and round."""
        base, used = np.array(self.base), self.rounds

        def steps(x: np.ndarray) -> list:
            now, out = np.tile(base, (len(x), 1)), []
            for trees in used:
                now = _margins(x, now, [trees], False)
                out.append(now)
            return [[step[i].tolist() for step in out] for i in range(len(x))]

        return df.select(key, F.posexplode(self._applied(df, steps, "array<array<double>>")).alias("at", "margin")).select(key, (F.col("at") + 1).alias("round"), "margin")

    def paths(self, df: DataFrame, key: str) -> DataFrame:
        """(key, round, class, node) of every node that a row passes, the root and its leaf included."""
        used = self.rounds

        def passed(x: np.ndarray) -> list:
            out: list[list] = [[] for _ in range(len(x))]
            for r, trees in enumerate(used):
                for k, tree in enumerate(trees):
                    for i, node in enumerate(tree.leaves(x, False).tolist()):
                        while node >= 0:
                            out[i].append((r + 1, k, node))
                            node = tree.parent[node]
            return out

        found = self._applied(df, lambda x: [[{"round": r, "class": k, "node": n} for r, k, n in row] for row in passed(x)], "array<struct<round:int,class:int,node:int>>")
        return df.select(key, F.inline(found))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, parent, depth, feature, threshold, missing_left, gain, cover, value) of every node; leaves have no feature."""
        rows = []
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                for n in range(len(t.feature)):
                    inner = t.feature[n] >= 0
                    rows.append((r + 1, k, n, t.parent[n] if n else None, t.depth[n], self.features[t.feature[n]] if inner else None, t.threshold[n] if inner else None, t.missing_left[n] if inner else None, t.gain[n] if inner else None, t.cover[n], None if inner else t.value[n]))
        return spark.createDataFrame(rows, NODES)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "round int, train double, valid double")


NODES = "round int, class int, node int, parent int, depth int, feature string, threshold double, missing_left boolean, gain double, cover double, value double"


def interactions(nodes: DataFrame, to_depth: int = 1) -> DataFrame:
    """(interaction, depth, gain, splits): summed gains of the columns on paths of ``depth`` + 1 splits, by the columns' names in order.

    A path's gain is the sum over its splits; depth 0 are single columns wherever they split.
    """
    inner = nodes.where("feature IS NOT NULL")
    paths = inner.select("round", "class", "parent", F.array("feature").alias("names"), "gain")
    out = paths.select(F.lit(0).alias("depth"), "names", "gain")
    above = inner.select(F.col("round").alias("up_round"), F.col("class").alias("up_class"), F.col("node").alias("up"), F.col("parent").alias("next"), F.col("feature").alias("name"), F.col("gain").alias("more"))
    for depth in range(1, to_depth + 1):
        joined = paths.join(above, (F.col("round") == F.col("up_round")) & (F.col("class") == F.col("up_class")) & (F.col("parent") == F.col("up")))
        paths = joined.select("round", "class", F.col("next").alias("parent"), F.concat("names", F.array("name")).alias("names"), (F.col("gain") + F.col("more")).alias("gain"))
        out = out.unionByName(paths.select(F.lit(depth).alias("depth"), "names", "gain"))
    return out.groupBy(F.array_join(F.array_sort("names"), "|").alias("interaction"), "depth").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))


def importance_by_depth(nodes: DataFrame) -> DataFrame:
    """(feature, depth, gain, splits, cover): what each column's splits gained at each depth of the trees."""
    return nodes.where("feature IS NOT NULL").groupBy("feature", "depth").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"), F.sum("cover").alias("cover"))


def _values(features: list[str]) -> Column:
    """The columns as an array of doubles with NaN where missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _stacked(x: pd.Series, n: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float, copy=False) if len(x) and n else np.empty((len(x), n))


def merged(rows: DataFrame, weight: str) -> DataFrame:
    """Rows that are equal but for ``weight`` as one with their sum, if at most half the rows are left by that (by an approximate count); else as they are."""
    keys = [c for c in rows.columns if c != weight]
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
    return rows.groupBy(*keys).agg(F.sum(weight).alias(weight)) if 2 * kinds <= n else rows


def _cuts(df: DataFrame, features: list[str], most: int) -> list[np.ndarray]:
    """Thresholds of each column at ``most`` quantiles; the largest value needs none."""
    known = [F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")).alias(c) for c in features]
    found = df.select(*known).approxQuantile(features, [i / most for i in range(1, most)], 0.25 / most)
    return [np.unique(np.array(q, float)) for q in found]


def boost(df: DataFrame, features: list[str], label: str, loss: str = "squared", n_rounds: int = 100, learning_rate: float = 0.1, max_depth: int = 3, ridge: float = 1.0, gamma: float = 0.0, least_cover: float = 1.0, subsample: float = 1.0, colsample: float = 1.0, max_bins: int = 64, weight: str | None = None, valid: str | None = None, patience: int = 0, seed: int = 0) -> Boosted:
    """Boosting of ``loss`` (``squared``: numbers; ``logistic``: labels 0 and 1; ``softmax``: any number of numeric classes).

    Rows where ``valid`` is true are not fitted; with ``patience`` it ends once their loss hasn't been at its lowest for so many rounds, and the model
    keeps the rounds up to the lowest. ``subsample`` deals rows to a round by a hash, ``colsample`` columns to a tree. Rows without a label are left out.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss is one of {LOSSES}")
    if patience and not valid:
        raise ValueError("stopping early takes held-out rows")
    if not 2 <= max_bins <= MISSING:
        raise ValueError("2 to 255 bins")
    ship_package(df.sparkSession)
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    y = F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)
    train = rows.where(~held)
    if loss == "squared":
        classes: list[float] = []
        total, n = train.agg(F.sum(w * y), F.sum(w)).first()
        base = np.array([total / n if n else 0.0])
    else:
        sizes = {r["y"]: r["n"] for r in train.groupBy(y.alias("y")).agg(F.sum(w).alias("n")).collect()}
        classes = sorted(sizes)
        if loss == "logistic":
            if not set(classes) <= {0.0, 1.0}:
                raise ValueError("labels of two classes are 0 and 1")
            classes = [0.0, 1.0]
            odds = max(sizes.get(1.0, 0.0), 1e-12) / max(sizes.get(0.0, 0.0), 1e-12)
            base = np.array([math.log(odds)])
        else:
            base = np.log(np.array([sizes[c] for c in classes]) / sum(sizes.values()))
    if loss == "softmax" and len(classes) < 2:
        raise ValueError("softmax takes two classes or more")
    k_all, n_features = len(base), len(features)
    cuts = _cuts(train, features, max_bins)
    bins = max(map(len, cuts), default=0) + 1

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = _stacked(part["x"], n_features)
            cells = np.empty(x.shape, np.uint8)
            for f, c in enumerate(cuts):
                cells[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], side="left"))
            own = part["y"].to_numpy()
            if loss == "softmax":
                place = np.searchsorted(classes, own)
                known = np.array(classes)[np.minimum(place, len(classes) - 1)] == own
                cells, own, part = cells[known], place[known].astype(float), part[known]  # held-out rows of a class that no fitted row has
            if len(own):
                yield pd.DataFrame({"x": [r.tobytes() for r in cells], "y": own, "w": part["w"], "held": part["held"], "u": part["u"], "m": [base.tolist()] * len(own)})

    kinds = "x binary, y double, w double, held boolean, u long, m array<double>"
    named = [f"x{f}" for f in range(n_features)]
    start = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, named, strict=True)], y.alias("y"), w.alias("w"), held.alias("held"), F.xxhash64(*features, label).alias("u"))
    state = stored(merged(start, "w").select(_values(named).alias("x"), "y", "w", "held", "u").mapInPandas(binned, kinds), "boosting")
    model = Boosted(features, loss, classes, base.tolist())
    rng = np.random.default_rng(seed)
    since: list[list[Tree]] = []  # rounds that the stored margins lack

    def unpacked(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(part["x"]), np.uint8).reshape(len(part), n_features)
        return x, _margins(x, np.stack(part["m"].to_numpy()), since, True)

    def level(growing: list[Tree], active: list[list[int]], allowed: list[list[int]], turn: int, final: bool = False) -> list:
        """Splits of the active nodes of each class's tree; the first level of a round also hands on the losses before it."""
        first = final or any(nodes == [0] for nodes in active)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [np.zeros((len(nodes), len(allowed[k]), (bins + 1), 2)) for k, nodes in enumerate(active)]
            losses = np.zeros(4)
            for part in batches:
                if not len(part):
                    continue
                x, margins = unpacked(part)
                g, h, lost = slopes(margins, part["y"].to_numpy(), loss)
                weights, out = part["w"].to_numpy(), part["held"].to_numpy(bool)
                losses += [weights[~out].sum(), (weights * lost)[~out].sum(), weights[out].sum(), (weights * lost)[out].sum()]
                if final:
                    continue
                drawn = ~out
                if subsample < 1:
                    mixed = (part["u"].to_numpy().astype(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    drawn &= (mixed >> np.uint64(11)).astype(float) / (1 << 53) < subsample
                x, g, h = x[drawn], g[drawn] * weights[drawn, None], h[drawn] * weights[drawn, None]
                cells = np.where(x == MISSING, bins, x).astype(np.int64)
                for k, nodes in enumerate(active):
                    place = np.full(len(growing[k].feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[growing[k].leaves(x, True)]
                    inside = at >= 0
                    for j, f in enumerate(allowed[k]):
                        cell = at[inside] * (bins + 1) + cells[inside, f]
                        for side, values in enumerate((g, h)):
                            found[k][:, j, :, side] += np.bincount(cell, values[inside, k], minlength=len(nodes) * (bins + 1)).reshape(len(nodes), bins + 1)
            keys = [(k, node, f) for k, nodes in enumerate(active) for node in nodes for f in allowed[k]]
            values = [found[k][i, j].reshape(-1).tolist() for k, nodes in enumerate(active) for i in range(len(nodes)) for j in range(len(allowed[k]))]
            if first:
                keys, values = [*keys, (-1, -1, -1)], [*values, losses.tolist()]
            yield pd.DataFrame({"k": [x[0] for x in keys], "node": [x[1] for x in keys], "f": [x[2] for x in keys], "s": values})

        def chosen(part: pd.DataFrame) -> pd.DataFrame:
            k, node, f = (int(part[c].iloc[0]) for c in ("k", "node", "f"))
            total = np.sum(np.stack(part["s"].to_numpy()), axis=0)
            if k < 0:
                return pd.DataFrame({"k": [k], "node": [node], "f": [f], "gain": [0.0], "bin": [0], "missing_left": [True], "sums": [total.tolist()]})
            total = total.reshape(-1, 2)
            whole = total.sum(axis=0).tolist()
            best = best_cut(total, ridge, gamma, least_cover)
            gain, at, missing_left, sides = best or (-1.0, 0, True, [0.0] * 4)
            return pd.DataFrame({"k": [k], "node": [node], "f": [f], "gain": [gain], "bin": [at], "missing_left": [missing_left], "sums": [[*whole, *sides]]})

        parts = state.mapInPandas(sums, "k int, node int, f int, s array<double>")
        return parts.groupBy("k", "node", "f").applyInPandas(chosen, "k int, node int, f int, gain double, bin int, missing_left boolean, sums array<double>").collect()

    def remember(found: list) -> None:
        """The losses that a pass over the rows has met belong to the rounds before it."""
        w_in, lost_in, w_out, lost_out = next(r["sums"] for r in found if r["k"] < 0)
        if model.rounds:
            model.history.append((len(model.rounds), lost_in / w_in if w_in else float("nan"), lost_out / w_out if w_out else None))

    def stale() -> bool:
        lost = [v for *_, v in model.history]
        return bool(patience and lost and None not in lost and len(lost) - 1 - int(np.argmin(lost)) >= patience)

    for turn in range(n_rounds):
        growing = [Tree() for _ in range(k_all)]
        allowed = [sorted(rng.choice(n_features, max(1, round(colsample * n_features)), replace=False).tolist()) for _ in range(k_all)]
        active = [[0] for _ in range(k_all)]
        for depth in range(max_depth):
            found = level(growing, active, allowed, turn)
            if depth == 0:
                remember(found)
                if stale():
                    break
            below: list[list[int]] = [[] for _ in range(k_all)]
            for k, tree in enumerate(growing):
                for node in active[k]:
                    own = sorted((r for r in found if r["k"] == k and r["node"] == node), key=lambda r: r["f"])
                    g, h = own[0]["sums"][:2]
                    tree.value[node], tree.cover[node] = -learning_rate * g / (h + ridge), h
                    best = max(own, key=lambda r: (r["gain"], -r["f"]))
                    if best["gain"] <= 0:
                        continue
                    cut = cuts[best["f"]]
                    threshold = float(cut[best["bin"]]) if best["bin"] < len(cut) else float("inf")
                    for side, (g, h) in zip(tree.split(node, best["f"], best["bin"], threshold, best["missing_left"], best["gain"]), (best["sums"][2:4], best["sums"][4:6]), strict=True):
                        tree.value[side], tree.cover[side] = -learning_rate * g / (h + ridge), h
                        below[k].append(side)
            active = below
            if not any(active):
                break
        if stale():
            break
        model.rounds.append(growing)
        since.append(growing)
        if len(since) >= STORE_EVERY and turn + 1 < n_rounds:

            def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in batches:
                    if len(part):
                        yield part.assign(m=unpacked(part)[1].tolist())

            newer = stored(state.mapInPandas(moved, kinds), "boosting")
            discard(state)
            state, since = newer, []
    else:
        remember(level([], [], [], n_rounds, final=True))
    discard(state)
    if patience and model.history:
        lost = [v for *_, v in model.history]
        if None not in lost:
            keep = int(np.argmin(lost)) + 1
            model.rounds, model.history = model.rounds[:keep], model.history[:keep]
    return model
