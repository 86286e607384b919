"""Near-copies in crowded buckets, fingerprints' classes with repeated and null ids, components of hubs and paths."""

import numpy as np
import pytest

from quern.llm import components as links
from quern.llm import simhash
from quern.llm.components import components


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size=5):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 24)
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(9000)])
    base, passage = rng.choice(words, 120), rng.choice(words, 60)
    texts = []
    for k in range(70):  # a large group of near copies, at similarities on both sides of the limit
        copy = base.copy()
        copy[rng.choice(120, int(rng.integers(1, 4)), replace=False)] = rng.choice(words, 1)
        texts.append(" ".join(copy))
    texts += [" ".join([*rng.choice(words, 25), *passage]) for _ in range(60)]  # one passage in many texts that differ
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root = union_find(pairs, range(len(texts)))
    got = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i for i, r in root.items() if i == r}
    assert len(want) > 55 and got >= want and len(got) <= len(want) * 1.02


def test_fingerprint_classes_of_repeated_and_null_ids(spark):
    near = lambda x, *bits: x ^ sum(1 << b for b in bits)
    a, b, c = 0x0123456789ABCDEF, 0x7EDCBA9876543210, 0x00FF00FF00FF00FF
    rows = [(5, a), (5, b), (7, near(a, 3, 40)), (9, near(b, 62)), (9, near(b, 62)), (None, near(a, 3, 41)), (None, c), (1, near(a, 3, 40, 7, 8))]
    got = simhash.link_classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert sorted((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in got) == sorted(
        (i or 0, f, 1 if bin(f ^ a).count("1") < 6 else 5 if bin(f ^ b).count("1") < 6 else None) for i, f in rows
    )


@pytest.mark.parametrize("seed", [1])
def test_fingerprint_classes_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << 62), 1 << 62, 12).tolist()
    fps = [int(base[rng.integers(12)]) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False))) for _ in range(400)]
    fps += [base[0] ^ k for k in range(256)]  # a full bucket: every fingerprint of eight bits
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2]
    want = union_find(pairs, range(len(fps)))
    got = simhash.link_classes(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components_of_hubs_and_paths(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2500) for i in range(100)]
    want = union_find(edges, {n for e in edges for n in e})
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(links, "MOST_SENT", 0)
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_share_a_leading_hash():
    rng = np.random.default_rng(17)
    counts = rng.integers(0, 5, 64).astype(np.int32)
    seen = 0
    for _ in range(20_000):
        n = int(rng.integers(1, 60))
        base = rng.choice(1 << 20, n, replace=False).astype(np.uint64)
        cut, more = rng.integers(0, n // 6 + 1), rng.integers(0, n // 6 + 2)
        a, b = np.sort(base), np.sort(np.concatenate([base[cut:], rng.choice(1 << 20, more).astype(np.uint64) + np.uint64(1 << 21)]))
        b = np.unique(b)
        if not len(b) or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) - 1e-9:
            continue
        seen += 1
        small, large = sorted((a, b), key=len)
        (x, lead), (y, _) = (simhash.prefix_of(s, counts, 0.8) for s in (small, large))
        assert set(x[:lead].tolist()) & set(y.tolist())
    assert seen > 2000


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """Texts that share most of their words meet in buckets far above the bound, and so do their parts; every planted pair is found."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(23)
    passage = [f"p{i}" for i in range(160)]
    texts = []
    for i in range(200):
        own = [f"o{i}x{k}" for k in range(34)]
        texts.append(passage + own)
        if i % 8 == 0:  # a pair at 0.8 or a little more
            keep = next(k for k in range(34) if len({*map(tuple, zip(*(([*passage, *own[:k]] + [f"n{i}x{j}" for j in range(34 - k)])[m:] for m in range(5))))} & {*map(tuple, zip(*((passage + own)[m:] for m in range(5))))}) >= 0.8 * (2 * 190) / 1.8)
            texts.append([*passage, *own[:keep], *(f"n{i}x{j}" for j in range(34 - keep))])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert len(pairs) == 25
    root = union_find(pairs, range(len(texts)))
    got = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)).collect()}
    want = {i for i, r in root.items() if i == r}
    assert got >= want and len(got - want) <= 1
