"""Operator 11: squares and runs against all places and periods, and the query against a plain version of its contract."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import tandem

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=24, min_exponent=3):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items() if b - a >= max(min_length, min_exponent * q)), key=lambda r: (r[0], r[2]))


def plain_squares(x):
    found = []
    for q in range(1, len(x) // 2 + 1):
        for i in range(len(x) - 2 * q + 1):
            root = x[i : i + q]
            if root == x[i + q : i + 2 * q] and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                found.append((i, q))
    return sorted(found, key=lambda s: (s[1], s[0]))


def strings():
    rng = np.random.default_rng(11)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ([0] * 40, [0, 1] * 20, [0, 1] * 20 + [0], fibonacci[-1], [0, 0, 1] * 9 + [2] + [1, 0, 0] * 9, list(range(30)), [3])
    for n in (2, 5, 12, 30, 60):
        for kinds in (1, 2, 3, 6):
            for _ in range(12):
                yield rng.integers(0, kinds, n).tolist()
    for _ in range(60):  # periodic stretches with faults between others
        out = []
        while len(out) < 80:
            root = rng.integers(0, 3, rng.integers(1, 9)).tolist()
            out += root * int(rng.integers(1, 6)) + rng.integers(0, 4, rng.integers(0, 5)).tolist()
        yield out


def test_squares_are_all_squares_of_primitive_roots():
    for x in strings():
        names = {v: k for k, v in enumerate(dict.fromkeys(x))}
        starts, periods = tandem.squares(np.array([names[v] for v in x]))
        assert list(zip(starts.tolist(), periods.tolist())) == plain_squares(x), x


@pytest.mark.parametrize("least, exponent", [(24, 3), (2, 2), (9, 3), (10, 4)])
def test_runs(least, exponent):
    for x in strings():
        words = [b"w%d" % v for v in x]
        assert tandem.runs_of(words, least, exponent) == plain_runs(words, least, exponent), x


def test_long_texts_in_time():
    rng = np.random.default_rng(3)
    root = [b"%d" % v for v in rng.integers(0, 5000, 7001)]
    words = [b"a"] * 30_000 + root * 4 + root[:17] + [b"b", b"c"] * 9000
    assert tandem.runs_of(words) == [(0, 30_000, 1), (30_000, 4 * 7001 + 17, 7001), (30_000 + 4 * 7001 + 17, 18_000, 2)]


def plain_row(name, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(name).encode())
    g = h // 10
    if name is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (name, len(runs), *best, milli, digest("".join(f"{s},{l},{q}\n" for s, l, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


TEXTS = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "é ß " * 12 + "end", "x y z " * 9 + "q " + "x y z " * 9, " a b \x1c c " * 30, "the same line\n" * 20 + "and more " * 40]
TEXTS += [" ".join(f"w{(i * i + k) % 31}" for i in range(120)) for k in range(40)]


def test_query_against_the_contract(spark, tmp_path):
    rows = [(i if i != 5 else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], 2, "y"), (7, TEXTS[7], 2, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = tandem.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)


def test_whole_table_against_the_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {tuple(plain_row(r["doc_id"], r["text"])) for r in docs.collect() if r["text"] is None or len(r["text"]) < 8000}
    got = {tuple(r) for r in tandem.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert want <= got and len(got) == docs.count()
    assert sum(r[1] for r in want) > 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tandem.periodic_runs(docs).count() == 0
    with pytest.raises(ValueError):
        tandem.periodic_runs(docs, min_exponent=1)
    one = tandem.periodic_runs(spark.createDataFrame([(1, "b a b a b a b c")], "doc_id long, text string"), min_length=4, min_exponent=2).first()
    assert [tuple(r) for r in one["runs"]] == [(0, 7, 2)] and one["collapsed"] == "b a c" and one["n_words"] == 8
    assert docs.select(F.lit(1)).count() == 0
