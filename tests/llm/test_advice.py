"""Whole jobs: near-copies by verified similarity, repeated and null ids, a tiny language, wide groups, open elements."""

import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from quern.llm import decontaminate, html_extract, language_id, quality, simhash


def shingles(text, size=5):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for k in range(150):
        base = rng.choice(words, int(rng.integers(8, 300)))
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05):
            copy = base.copy()
            at = rng.random(len(base)) < share
            copy[at] = rng.choice(words, int(at.sum()))
            texts.append(" ".join(copy))
    texts += [" ".join(["a"] * 60), " ".join(["a"] * 60 + [f"z{i}" for i in range(40)])]  # one fingerprint, little in common
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if find(i) == i}
    got = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (None, b), (None, c), (None, c), (1, a)]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, c), (1, a), (5, b)]


def test_decontamination_beyond_the_sent_size_judges_rows(spark, monkeypatch):
    item = " ".join(f"i{k}" for k in range(12))
    docs = spark.createDataFrame([(1, item), (1, "clean one two three four five"), (None, f"x {item}"), (None, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(r["text"] for r in decontaminate.keep_uncontaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MOST_ITEM_BYTES", 0)
    assert sorted(r["text"] for r in decontaminate.keep_uncontaminated(docs, items).collect()) == want == ["clean", "clean one two three four five"]


def test_a_tiny_language_takes_nothing(spark):
    rng = np.random.default_rng(2)
    make = {k: [f"{k}{''.join(rng.choice(list(letters), 5))}" for _ in range(400)] for k, letters in (("a", "bcdfe"), ("m", "nopqu"))}
    texts = [(i, " ".join(rng.choice(make[k], 40)), k) for i, k in enumerate(["a", "m"] * 120)]
    df = spark.createDataFrame([*texts, (10_000, " ".join(f"tiny{c}" for c in "abcdefghijklmno"), "zz")], "doc_id long, text string, lang string")
    model = language_id.train(df.where((language_id.fold() != 2) | (F.col("lang") == "zz")).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert all(got[i][0] == k and got[i][1] > 0.5 for i, _, k in texts) and got[10_000][0] == "zz"


def test_every_language_has_words_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_WORDS", 3)
    rows = [(i, "big one two three four five " * 50, "aa") for i in range(20)] + [(100, "rara rara", "bb")]
    model = language_id.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert "rara" in model.keys.split("\n")


def test_each_rule_fires_in_a_wide_group(spark):
    rng = np.random.default_rng(3)
    words = [f"word{''.join(rng.choice(list('abcdefghijk'), 4))}" for _ in range(3000)]

    def text(share, change, n=120):
        own = list(rng.choice(words, n, replace=False))
        return " ".join(change(w) if i < share * n else w for i, w in enumerate(own))

    def lines(share, n=40):
        own = [" ".join(rng.choice(words, 4)) for _ in range(n)]
        return "\n".join("same here" if i < share * n else x for i, x in enumerate(own))

    def stutter(share, n=120):
        return " ".join(f"{w}" if rng.random() > share else f"{w} {w}" for w in rng.choice(words, n, replace=False))

    junk = {
        "symbols_per_word": lambda s: text(s, lambda w: f"{w}$"),
        "shout_share": lambda s: text(s, str.upper),
        "dup_line_share": lines,
        "stutter_share": stutter,
        "mean_word": lambda s: text(s, lambda w: w * 2),
    }
    worst = {
        "symbols_per_word": text(1, lambda w: f"{w}$$$$$$"),
        "shout_share": text(1, str.upper),
        "dup_line_share": lines(0.97),
        "stutter_share": " ".join(f"{w} {w} {w}" for w in rng.choice(words, 60, replace=False)),
        "mean_word": text(1, lambda w: w * 6),
    }
    rows = []
    for k, make in junk.items():
        rows += [(f"{k}-{i}", make(float(s)), "en", k) for i, s in enumerate(np.linspace(0, 0.6, 80))] + [(f"{k}-worst", worst[k], "en", k)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    limits = {r["source_key"]: r for r in quality.thresholds(df).collect()}
    seen = {r["doc_id"]: r for r in quality.with_measures(df, windows=False).select("doc_id", *[c.alias(k) for k, c in quality.ratios().items()]).collect()}
    for k in quality.RULES:
        assert seen[f"{k}-worst"][k] > limits[k][f"max_{k}"], k
        assert k == "mean_word" or k == "symbols_per_word" or limits[k][f"max_{k}"] < 0.95


def test_open_and_empty_elements_cut_nothing():
    page = html_extract.Page("<p>a<svg class=icon /><p>b<div><noscript>n</div><p>c<template>t<p>d")
    assert [t for _, t in page.flow if t] == ["a", "b", "n", "c", "t", "d"]
    run = "from quern.llm.html_extract import Page; Page('<p>x</p><a href=' + 'h' * 5000)"
    subprocess.run([sys.executable, "-c", run], check=True, timeout=60)
