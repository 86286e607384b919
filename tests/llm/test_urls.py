"""The n-gram models against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np

from quern.llm import url_filter
from quern.llm.url_filter import ALPHABET, ORDER


def model(texts):
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        padded = "^" * ORDER + t + "$"
        for i in range(ORDER, len(padded)):
            for k in range(ORDER + 1):
                counts[k][padded[i - k : i + 1]] += 1
    totals = [defaultdict(int) for _ in counts]
    kinds = [defaultdict(int) for _ in counts]
    for k, c in enumerate(counts):
        for gram, n in c.items():
            totals[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1

    def p(gram):
        if not gram:
            return 1 / ALPHABET
        k, context = len(gram) - 1, gram[:-1]
        n, t = totals[k][context], kinds[k][context]
        return (counts[k][gram] + t * p(gram[1:])) / (n + t) if n else p(gram[1:])

    return p


def test_ratios_and_scores_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab./1é字"), int(rng.integers(1, 14)))) for _ in range(120)] + ["", "zz" * 40]
    labels = [bool(i % 3 == 0) if i % 5 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, labels))], "row long, text string, rejected boolean")
    rejected, accepted = (model([t for t, k in zip(texts, labels) if t and k is want]) for want in (True, False))
    ratios = url_filter.log_ratios(df)
    for r in ratios.collect():
        assert abs(r["ratio"] - (math.log(rejected(r["gram"])) - math.log(accepted(r["gram"])))) < 1e-9
    scores = {r["row"]: r["score"] for r in url_filter.mean_ratios(df, ratios).collect()}
    for i, t in enumerate(texts):
        padded = "^" * ORDER + t + "$"
        own = [padded[k : k + ORDER + 1] for k in range(len(t) + 1)]
        if t:
            assert abs(scores[i] - np.mean([math.log(rejected(g)) - math.log(accepted(g)) for g in own])) < 1e-9
        else:
            assert i not in scores


def test_a_held_out_threshold_parts_the_classes(spark):
    rng = np.random.default_rng(1)
    name = lambda letters: "".join(rng.choice(list(letters), 8))
    urls = [f"http://{name('abcde')}.org/x" for _ in range(300)] + [f"http://{name('vwxyz')}-casino.org/x" for _ in range(100)]
    out = url_filter.filtered_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    verdicts = {r["page_id"]: r["verdict"] for r in out}
    assert len(out) == len(urls) and all(verdicts[i] == "allow" for i in range(300))
    assert all(verdicts[i] == "block" for i in range(300, 400))


def test_only_frequent_grams_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["www.example.org/" + "".join(rng.choice(list("abcdefgh0123"), int(rng.integers(1, 12)))) for _ in range(150)] + [""]
    df = spark.createDataFrame([(i, t, bool(i % 3 == 0) if i % 5 else None) for i, t in enumerate(texts)], "row long, text string, rejected boolean")
    ratios, sent, send = url_filter.log_ratios(df), [], url_filter.F.broadcast
    table = {r["gram"]: r["ratio"] for r in ratios.collect()}
    monkeypatch.setattr(url_filter, "MOST_COMMON", 100, raising=False)
    monkeypatch.setattr(url_filter.F, "broadcast", lambda t: sent.append(t.count()) or send(t))
    scores = {r["row"]: r["score"] for r in url_filter.mean_ratios(df, ratios).collect()}
    assert len(table) > 100 and sent and 0 < max(sent) < 100 and scores.keys() == set(range(150))
    for i, t in enumerate(texts[:-1]):
        padded = "^" * ORDER + t + "$"
        assert abs(scores[i] - np.mean([table[padded[k : k + ORDER + 1]] for k in range(len(t) + 1)])) < 1e-9
