"""Operator 8 against a row-by-row version that holds every frequency, with many languages, mistyped labels and very long texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id


def plain_scores(labelled, most_words, most_grams, text):
    """The softmax share of each language, from the counts themselves; every frequency is written out, pooled ones too."""
    langs = sorted({lang for _, lang in labelled})
    words = {lang: Counter() for lang in langs}
    for t, lang in labelled:
        words[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in words[lang].items():
            s = f"^{w}$"
            for k in range(1, language_id.LONGEST + 1):
                for i in range(len(s) - k + 1):
                    grams[lang][s[i : i + k]] += n

    def table(counts, most):
        pooled = sum(counts.values(), Counter())
        kept = {lang: {k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] if pooled[k] > 1} for lang, c in counts.items()}
        return pooled, kept, set().union(*kept.values())

    totals = {lang: [sum(words[lang].values())] + [sum(n for g, n in grams[lang].items() if len(g) == k) for k in range(1, language_id.LONGEST + 1)] for lang in langs}
    by = {"w": (words, *table(words, most_words)), "g": (grams, *table(grams, most_grams))}

    def log(kind, key, lang):
        counts, pooled, kept, _ = by[kind]
        size = 0 if kind == "w" else len(key)
        share = pooled[key] / sum(totals[x][size] for x in langs)
        own = counts[lang][key] if key in kept[lang] else 0
        return math.log((own + language_id.LEAN * share) / (totals[lang][size] + language_id.LEAN))

    found = re.findall(r"[^\W\d_]+", text.lower())
    total = dict.fromkeys(langs, 0.0)
    for w in found:
        if w in by["w"][3]:
            used, weight = [("w", w)], 1
        else:
            s, used = f"^{w}$", []
            for i in range(len(s) - 1):
                part = next((s[i : i + k] for k in range(language_id.LONGEST, 0, -1) if len(s[i : i + k]) == k and s[i : i + k] in by["g"][3]), None)
                used += [("g", part)] if part else []
            weight = 1 / max(1, len(w) + 3 - language_id.LONGEST)
        for lang in langs:
            total[lang] += weight * sum(log(*u, lang) for u in used)
    scale = min(1.0, language_id.CAP / len(found))
    top = max(total.values())
    share = {lang: math.exp(scale * (v - top)) for lang, v in total.items()}
    return {lang: v / sum(share.values()) for lang, v in share.items()}


def made(rng, languages, texts):
    letters = [list(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüéèñ"), 9, replace=False)) for _ in range(languages)]
    vocabulary = [["".join(rng.choice(x, rng.integers(2, 7))) for _ in range(150)] for x in letters]
    return [(" ".join(rng.choice(vocabulary[k % languages], rng.integers(5, 30))) + (" the same" if k % 3 else ""), f"l{k % languages:03d}") for k in range(texts)], vocabulary


@pytest.mark.parametrize("most_words, most_grams", [(40_000, 30_000), (25, 40)])
def test_scores_equal_a_plain_version(spark, monkeypatch, most_words, most_grams):
    monkeypatch.setattr(language_id, "MOST_WORDS", most_words)
    monkeypatch.setattr(language_id, "MOST_GRAMS", most_grams)
    labelled, vocabulary = made(np.random.default_rng(4), 4, 80)
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "id long, text string, lang string").repartition(3))
    scorer = language_id.Scorer(model)
    rng = np.random.default_rng(5)
    for k in range(30):
        words = [w[: rng.integers(1, 9)] + "xq"[: rng.integers(0, 3)] for w in rng.choice(vocabulary[k % 4], rng.integers(1, 40))]
        text = " ".join([*words, "Same", "12"])
        want = plain_scores(labelled, most_words, most_grams, text)
        got = scorer.predict(text)
        assert got[1] == pytest.approx(max(want.values()), abs=1e-5) and want[got[0]] == pytest.approx(max(want.values()), abs=1e-5)


def test_a_hundred_languages_in_linear_memory(spark, monkeypatch):
    labelled, vocabulary = made(np.random.default_rng(6), 100, 1500)
    rows = [(i, *r) for i, r in enumerate(labelled)] + [(10_000 + i, f"odd label {i}", f"typo{i}") for i in range(450)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    monkeypatch.setattr(language_id, "MOST_KEYS", 50_000)
    model = language_id.train(df)
    assert len(model.languages) == language_id.MOST_LANGUAGES == 500 and len(model.ratio) <= 50_000
    scorer = language_id.Scorer(language_id.train(df.where(F.col("id") < 10_000)))
    rng = np.random.default_rng(7)
    right = sum(scorer.predict(" ".join(rng.choice(vocabulary[k], 30)))[0] == f"l{k:03d}" for k in range(100))
    assert right >= 97


def test_very_long_texts_in_parts(spark, monkeypatch):
    labelled, vocabulary = made(np.random.default_rng(8), 3, 60)
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "id long, text string, lang string"))
    text = " ".join(f"{w}{c}" for w in vocabulary[1] for c in "abcdefghij") * 20
    whole = language_id.Scorer(model).predict(text)
    monkeypatch.setattr(language_id, "GATHER", 50)
    assert language_id.Scorer(model).predict(text) == pytest.approx(whole) and whole[0] == "l001"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 34")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = language_id.identify(docs, model).collect()
    assert [r["lang_pred"] for r in got] == ["l001"] * 3 + ["und"] * 3 and [r["score"] for r in got[3:]] == [0.0] * 3
    assert language_id.train(docs.select(F.col("doc_id").alias("id"), "text", F.lit("x").alias("lang")).where("false")) is None
    assert language_id.identify(docs.where("false"), model).count() == 0
