"""Thresholds against exact quantiles, the verdict against brute force, clashing columns, repeatable sketches."""

import math

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality


def rows_of(seed=0, n=400):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{'abcdefghij'[i % 10] * (1 + i % 7)}" for i in range(3000)])
    out = []
    for i in range(n):
        own = list(rng.choice(words, int(rng.integers(15, 200))))
        kind = rng.integers(8)
        if kind == 0:
            own = [f"{w}$" if rng.random() < 0.3 else w for w in own]
        if kind == 1:
            own = [w.upper() if rng.random() < 0.5 else w for w in own]
        if kind == 2:
            own = [x for w in own for x in ([w, w] if rng.random() < 0.4 else [w])]
        text = "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in own)
        out.append((i, text + (text[: text.find("\n") + 1] * 3 if kind == 3 else ""), ["en", "de", None][i % 3], ["a", "b", "rare"][min(2, i % 100 // 45)], "x"))
    return out + [(n, None, "en", "a", "x"), (n + 1, "", None, None, "x")]


def brute(text):
    t = text or ""
    words = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(" \t")]
    n, chars = len(words), sum(map(len, words))
    return {
        "n_words": n, "word_chars": chars, "n_lines": len(lines),
        "symbols_per_word": sum(c in "#*$%&|<>" for c in t) / max(1, n),
        "shout_share": sum("A" <= c <= "Z" or c == "!" for c in t) / max(1, chars),
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "stutter_share": sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        "mean_word": chars / max(1, n),
    }


def limit(group, k):
    """The threshold from exact quantiles: the smallest value with at least the share of documents at or below it."""
    by, count, most, change = quality.RULES[k]
    at = lambda name, q: sorted(m[name] for m in group)[math.ceil(q * len(group)) - 1]
    low, mid = at(k, 0.25), at(k, 0.5)
    noise = 2 / math.sqrt(max(1, at(count, 0.5))) * (mid if k == "mean_word" else 1)
    return mid + min(by * (mid - low) + noise, most + change * mid), 0.01 * (mid + by * (mid + low) + noise + abs(most) + mid)


def test_thresholds_and_verdicts_equal_exact_quantiles(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m string")
    measures = {r[0]: brute(r[1]) for r in rows}
    key = lambda r: (r[2] or quality.NO_VALUE, r[3] or quality.NO_VALUE)
    by_group, by_lang = {}, {}
    for r in rows:
        by_group.setdefault(key(r), []).append(measures[r[0]])
        by_lang.setdefault(key(r)[0], []).append(measures[r[0]])
    got = {(r["lang_key"], r["source_key"]): r for r in quality.thresholds(df).collect()}
    assert set(got) == set(by_group) and any(len(g) < quality.LEAST_GROUP for g in by_group.values())
    for name, group in by_group.items():
        chosen = group if len(group) >= quality.LEAST_GROUP else by_lang[name[0]]
        for k in quality.RULES:
            want, slack = limit(chosen, k)
            assert abs(got[name][f"max_{k}"] - want) <= slack, (name, k, got[name][f"max_{k}"], want)
    out = quality.judged(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "m", "base_failed", "kept"]
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    for r in rows:
        own, cut = measures[r[0]], got[key(r)]
        failed = any(own[k] > cut[f"max_{k}"] + 1e-12 for k in quality.RULES)
        assert not kept[r[0]] or not failed
        if not failed and own["n_words"] >= 20 and own["stutter_share"] == 0 and own["dup_line_share"] == 0:
            assert kept[r[0]], r[0]
    assert 0 < sum(kept.values()) < len(rows) - 20


def test_thresholds_are_repeatable(spark):
    df = spark.createDataFrame(rows_of(3), "doc_id long, text string, lang string, source string, m string")
    first = {tuple(r) for r in quality.thresholds(df).collect()}
    assert first == {tuple(r) for r in quality.thresholds(df.repartition(7, F.rand(5))).collect()}
    assert quality.keep_good(df.where("false")).count() == 0
