"""Operator 13 against a plain version on small tables with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quern.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    words = WORDS.findall((text or "").translate(LOW))
    return words, Counter(" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))


def plain(docs, target, percent, buckets, most):
    def sums(texts):
        out = Counter()
        for t in texts:
            for f, n in features(t, most)[1].items():
                out[zlib.crc32(f.encode()) % buckets] += n
        return out

    s, t = sums(x for _, x in docs), sums(target)
    big_s, big_t = s.total(), t.total()
    rows = []
    for place, (name, text) in enumerate(docs):
        words, own = features(text, most)
        w = sum(n * math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for f, n in own.items() for b in [zlib.crc32(f.encode()) % buckets])
        h = int(hashlib.sha256(f"2024:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append([name, own.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words), place])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


TEXTS = [None, "", "..", "One TWO é three", "x" * 100 + " common " + "y" * 70, "ÀB straße ǅ " * 12, "the " * 300 + "end", *[" ".join(f"w{(i * j) % 23} the" for j in range(15)) for i in range(20)]]
DOCS = [(i if i % 11 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (8, TEXTS[8]), (8, TEXTS[8])]
TARGET = ["w1 the w2 the w3", None, "", "x" * 100, "straße common common"]


@pytest.mark.parametrize("most, percent, frequent", [(1, 10, 100_000), (1, 50, 20), (3, 100, 40)])
def test_resampling(spark, monkeypatch, most, percent, frequent):
    monkeypatch.setattr(importance, "FREQUENT", frequent)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, score int, features string").repartition(3)
    target = spark.createDataFrame([(t, 2) for t in TARGET], "text string, bucket int")
    got = importance.resample(docs, target, percent, 97, most_words=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain(DOCS, TARGET, percent, 97, most)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert importance.resample(docs.where("false"), docs, id_column="doc_id").count() == 0
    got = importance.resample(docs, target, 100, 50)
    assert sorted(map(tuple, got.collect()), key=str) == plain(DOCS, [], 100, 50, 1)
    assert importance.resample(docs.where("false"), target).count() == 0
