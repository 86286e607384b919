"""Boosting against a plain version on all rows at once, with missing values, weights, several classes and early stopping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting as B


def rows(n=600, seed=3, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    x[rng.random(n) < 0.1, 1] = np.nan
    signal = x[:, 0] + np.where(np.isnan(x[:, 1]), 1.5, x[:, 1]) * (x[:, 2] > 0)
    y = np.digitize(signal + rng.normal(size=n) * 0.3, np.quantile(signal, np.linspace(0, 1, classes + 1)[1:-1])).astype(float)
    return x, y, signal


def frame(spark, x, y, **more):
    names = ["a", "b", "c", "y", *more]
    data = [tuple(None if np.isnan(v) and j == 1 and i % 2 else float(v) for j, v in enumerate(r)) + (float(t),) + tuple(m[i].item() for m in more.values()) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, names).repartition(3)


def plain(x, y, w, loss, cuts, rounds, depth=2, rate=0.3, ridge=1.0):
    """Margins of every row after ``rounds``, by trying each cut of each column on the rows themselves."""
    k = int(y.max()) + 1 if loss == "softmax" else 1
    base = np.log(np.array([w[y == c].sum() for c in range(k)]) / w.sum()) if k > 1 else np.array([np.average(y, weights=w)]) if loss == "squared" else np.array([np.log(w[y == 1].sum() / w[y == 0].sum())])
    m = np.tile(base, (len(y), 1))
    for _ in range(rounds):
        g, h, _ = B.slopes(m, y, loss)
        step = np.zeros_like(m)

        def grow(at, left_depth, c):
            gs, hs = (g[:, c] * w)[at], (h[:, c] * w)[at]
            score = lambda a, b: a * a / (b + ridge)
            best = (1e-9, None)
            if left_depth:
                for f in range(x.shape[1]):
                    for cut in [*cuts[f], np.inf]:
                        for missing_left in (True, False):
                            v = x[at, f]
                            go = np.where(np.isnan(v), missing_left, v <= cut)
                            if min(hs[go].sum(), hs[~go].sum()) < 1:
                                continue
                            gain = 0.5 * (score(gs[go].sum(), hs[go].sum()) + score(gs[~go].sum(), hs[~go].sum()) - score(gs.sum(), hs.sum()))
                            if gain > best[0] + 1e-9:
                                best = (gain, go)
            if best[1] is None:
                step[at, c] = -rate * gs.sum() / (hs.sum() + ridge)
                return
            grow(at[best[1]], left_depth - 1, c)
            grow(at[~best[1]], left_depth - 1, c)

        for c in range(k):
            grow(np.arange(len(y)), depth, c)
        m = m + step
    return m


@pytest.mark.parametrize("loss", ["softmax", "logistic", "squared"])
def test_boosting_equals_a_plain_version(spark, monkeypatch, loss):
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    x, y, signal = rows(classes=3 if loss == "softmax" else 2)
    y = signal.round(3) if loss == "squared" else y
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float)
    df = frame(spark, x, y, w=w, i=np.arange(len(y)))
    m = B.boost(df, ["a", "b", "c"], "y", loss, n_rounds=3, learning_rate=0.3, max_depth=2, max_bins=12, weight="w")
    cuts = B._cuts(df, ["a", "b", "c"], 12)
    want = plain(x, y, w, loss, cuts, 3)
    got = m.predict(df, margin="margin").orderBy("i").collect()
    assert np.allclose(np.array([r["margin"] for r in got]), want, atol=1e-9)
    lost = (B.slopes(want, y, loss)[2] * w).sum() / w.sum()
    assert m.history[-1] == (3, pytest.approx(lost), None)
    assert all(a[1] > b[1] for a, b in zip(m.history, m.history[1:]))
    if loss == "softmax":
        assert np.allclose(np.array([r["probability"] for r in got]), B.chances(want, loss)) and np.array([r["prediction"] == t for r, t in zip(got, y)]).mean() > 0.65
    stages = {(r["i"], r["round"]): r["margin"] for r in m.staged(df, "i").collect()}
    assert len(stages) == 3 * len(y) and np.allclose([stages[i, 3] for i in range(len(y))], want)
    paths = m.paths(df, "i").join(m.nodes(spark), ["round", "class", "node"])
    ends = paths.where("value IS NOT NULL").groupBy("i", "class").agg(F.sum("value").alias("v")).collect()
    assert all(r["v"] + m.base[r["class"]] == pytest.approx(want[r["i"], r["class"]]) for r in ends) and len(ends) == want.size


def test_held_out_rows_stop_it_for_several_classes(spark):
    x, y, _ = rows(500, seed=5)
    noise = np.random.default_rng(2).integers(0, 3, 500).astype(float)
    y = np.where(np.arange(500) % 2 == 0, y, noise)
    df = frame(spark, x, y, valid=np.arange(500) % 3 == 0)
    m = B.boost(df, ["a", "b", "c"], "y", "softmax", n_rounds=30, learning_rate=1.0, valid="valid", patience=2)
    lost = [v for *_, v in m.history]
    assert len(m.rounds) == len(m.history) < 30 and lost[-1] == min(lost)
    full = B.boost(df, ["a", "b", "c"], "y", "softmax", n_rounds=len(m.rounds), learning_rate=1.0, valid="valid")
    assert full.history == [(i, pytest.approx(t), pytest.approx(v)) for i, t, v in m.history]
    p = m.predict(df.where("valid")).select(F.get("probability", F.col("y").cast("int")).alias("p")).agg(-F.avg(F.log("p"))).first()[0]
    assert p == pytest.approx(lost[-1])


def test_gains_by_depth_and_pairs(spark):
    x, y, _ = rows(400, seed=7, classes=2)
    m = B.boost(frame(spark, x, y), ["a", "b", "c"], "y", "logistic", n_rounds=4, max_depth=3)
    want, pairs = {}, {}
    for t in (t for r in m.rounds for t in r):
        for n, f in enumerate(t.feature):
            if f >= 0:
                want[m.features[f], t.depth[n]] = want.get((m.features[f], t.depth[n]), 0) + t.gain[n]
                if n:
                    up = t.parent[n]
                    key = "|".join(sorted((m.features[f], m.features[t.feature[up]])))
                    pairs[key] = pairs.get(key, 0) + t.gain[n] + t.gain[up]
    nodes = m.nodes(spark)
    assert {(r["feature"], r["depth"]): pytest.approx(r["gain"]) for r in B.importance_by_depth(nodes).collect()} == want
    found = B.interactions(nodes, 1).collect()
    assert {r["interaction"]: pytest.approx(r["gain"]) for r in found if r["depth"] == 1} == pairs
    single = {r["interaction"]: r["gain"] for r in found if r["depth"] == 0}
    assert all(single[f] == pytest.approx(sum(v for (g, _), v in want.items() if g == f)) for f in single)


def test_samples_of_rows_and_columns_and_wrong_calls(spark, monkeypatch):
    x, y, _ = rows(300, seed=9, classes=2)
    df = frame(spark, x, y)
    cuts = B._cuts(df, ["a", "b", "c"], 64)
    monkeypatch.setattr(B, "_cuts", lambda *_: cuts)  # approximate quantiles depend on how rows are dealt, samples don't
    m = B.boost(df, ["a", "b", "c"], "y", "logistic", n_rounds=5, subsample=0.5, colsample=0.4)
    again = B.boost(df.repartition(5), ["a", "b", "c"], "y", "logistic", n_rounds=5, subsample=0.5, colsample=0.4)
    assert [t.feature for r in m.rounds for t in r] == [t.feature for r in again.rounds for t in r]
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for r in m.rounds for t in r)
    for bad in ({"loss": "other"}, {"patience": 3}, {"max_bins": 300}):
        with pytest.raises(ValueError):
            B.boost(df, ["a"], "y", **bad)


def test_equal_rows_are_stored_as_one(spark, monkeypatch):
    x, y, _ = rows(150, seed=11)
    times = np.random.default_rng(4).integers(2, 6, 150)
    once = frame(spark, x, y, w=times.astype(float), i=np.arange(150))
    many = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    cuts, kept, store = B._cuts(once, ["a", "b", "c"], 12), [], B.stored
    monkeypatch.setattr(B, "_cuts", lambda *_: cuts)
    monkeypatch.setattr(B, "stored", lambda df, tag: kept.append(store(df, tag).count()) or store(df, tag))
    fitted = [B.boost(df, ["a", "b", "c"], "y", "softmax", n_rounds=3, learning_rate=0.3, subsample=0.8, weight=w) for df, w in ((once, "w"), (many, None))]
    assert kept[1] == kept[0] == 150 and many.count() == times.sum()
    one, two = (np.array([r["margin"] for r in m.predict(once, margin="margin").orderBy("i").collect()]) for m in fitted)
    assert np.allclose(one, two, atol=1e-9) and [t for _, t, _ in fitted[0].history] == pytest.approx([t for _, t, _ in fitted[1].history])
