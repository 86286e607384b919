"""The operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, html_extract, language_id, licenses, packing, quality, simhash, token_counts, token_store, url_filter
from quern.llm.tokens import encoder, tokenizer_path

LONG = " ".join(f"w{i % 977}" for i in range(6000))
TEXTS = [None, "", " ", "One two three four five six seven", "One two three four five six seven", "é ß  x\n\n<|endoftext|>y don't we're", LONG, "a " * 40, "1234567 !!\t ok", "same line\nsame line\n\nsame line", LONG + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], "src0" if i % 2 else None, i, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def ids():
    by = encoder(tokenizer_path())
    return {i: by.library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_prefix_counts_are_exact(spark, docs):
    by = token_counts.counter(tokenizer_path())
    for t in (t for t in TEXTS if t is not None and len(t) < 100):
        want = [len(by.source.library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert token_counts.prefix_counts(by.deltas(t)).tolist() == want
    table = token_counts.token_table(docs, tokenizer_path())
    row = table.where("doc_id = 3").select(token_counts.tokens_of_prefix(F.col("prefix_table"), F.lit(7)), token_counts.longest_prefix(F.col("prefix_table"), 2)).first()
    assert row[0] == 2 and row[1] == 7
    assert table.where("doc_id = 0").first()["n_tokens"] == 0


def test_counts_match_the_library(docs, ids):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_table(docs, tokenizer_path()).collect()}
    assert got == {k: len(v) for k, v in ids.items()}


def test_token_files_round_trip(spark, docs, ids, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), end_id=2)
    start = 0
    for r in token_store.read_tokens(spark, str(tmp_path / "t"), with_ids=True).orderBy("doc_id").collect():
        want = np.array([*ids[r["doc_id"]], 2], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(want), want.tobytes())
        start += len(want)


def test_code_lengths_are_best_and_limited():
    counts = np.array([1, 1, 2, 4, 8, 16, 0, 32])
    free, short = token_store.code_lengths(counts, 20), token_store.code_lengths(counts, 4)
    heap = sorted(counts[counts > 0].tolist())
    cost = 0
    while len(heap) > 1:  # Huffman's own rule: the cost is the sum of all merged weights
        cost += heap[0] + heap[1]
        heap = sorted([*heap[2:], heap[0] + heap[1]])
    assert (free * counts).sum() == cost and free[6] == 0
    assert short.max() == 4 and sum(2.0 ** -int(x) for x in short if x) <= 1
    one = token_store.code_lengths(np.array([0, 5]))
    assert one.tolist() == [0, 1]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_block_round_trip(n):
    values = np.random.default_rng(n).zipf(1.3, n) % 300
    lengths = token_store.code_lengths(np.bincount(values, minlength=300))
    payload, points = token_store.encode_block(values, token_store.canonical_codes(lengths), lengths)
    assert (token_store.decode_block(payload, points, n, token_store.decode_table(lengths)) == values).all()


def test_packing(docs, ids):
    out = packing.pack_documents(docs, tokens=256).collect()
    place = defaultdict(list)
    whole = defaultdict(int)
    for r in out:
        own = np.array([*ids[r["doc_id"]], 0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["length"] == len(own)
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]] += r["length"]
    assert dict(whole) == {k: len(v) + 1 for k, v in ids.items()}
    for parts in place.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256


def test_packing_keeps_every_limit():
    sequence, _ = packing.best_fit(np.array([50, 50, 40, 10, 10, 5]), 100, 2, 100.0**2 / 2, rule="dot")
    for k in set(sequence.tolist()):
        own = np.array([50, 50, 40, 10, 10, 5])[sequence == k]
        assert own.sum() <= 100 and len(own) <= 2 and (own**2).sum() <= 5000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 2, 1e9)


def test_simhash_classes(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: simhash.fingerprint(t, 3) & (2**64 - 1) for i, t in enumerate(TEXTS)}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert got[0]["fp"] == 0 and root[3] == root[4] == 3


@pytest.mark.parametrize("radius", [0, 1, 2, 6])
def test_bit_planes_find_every_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 20, 200)] ^ flips ^ np.roll(flips, 3)]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)) if i < j}
    assert set(map(tuple, np.concatenate(list(simhash._large_bucket(fps, fps, radius, True))).tolist())) == want


def test_one_of_each_stays(docs):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {0, 3, 5, 6, 7, 8, 9}


def test_contained_items(spark, docs):
    items = spark.createDataFrame([(1, "TWO three, four five six"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (3, None), (4, ""), (5, "one two"), (6, "w5 w6 w7 w8 w9 w100 w3 w12 w13 w14")], "item_id long, text string")
    want = {(3, 1), (4, 1), (6, 2), (10, 2), (3, 5), (4, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()} == want
    chosen = items.select(F.col("item_id").alias("item"), "text")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate._joined(docs, chosen, 0.8, "doc_id", "text", "item_id").collect()} == want
    assert {r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, items).collect()} == set(range(11)) - {3, 4, 6, 10}


def test_quality_measures(docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = {r["doc_id"]: r for r in quality.judged(docs.drop("score")).collect()}
    for i, t in enumerate(TEXTS):
        words = word.findall(t or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        n = Counter(windows)
        covered = {p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        m = out[i]["m"]
        assert (m["n_words"], m["word_chars"], m["n_dup_lines"], m["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert out[i]["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_catches_symbols(spark):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(500)]
    good = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    bad = [" ".join(f"{w}$$$" for w in rng.choice(words, 60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == set(range(80))


def test_urls(spark):
    urls = [None, "", "mailto:x", "https://A.Example.NET/en/1?q#f", "http://example.net", "http://b.net/x", "http://example.com/de/2", "http://x.org/fr/", "http://casino.example.org/a", "http://news.example.org/a"]
    urls += [f"http://site{i}.example.org/en/{i}" for i in range(40)] + [f"http://casino-{i}.example.org/en/{i}" for i in range(10)]
    out = {r["page_id"]: r for r in url_filter.filtered_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "", None, "allow"), ("b.net", "/x", "net/", "block"), ("example.com", "/de/2", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow")]
    assert out[8]["verdict"] == "block" and out[9]["verdict"] == "allow" and all(out[i]["verdict"] == ("block" if i >= 50 else "allow") for i in range(10, 60))


def test_languages(spark):
    rng = np.random.default_rng(1)
    make = {"aa": ["lorra", "sitta", "komma"], "bb": ["xuq", "zuq", "yuqs"]}
    rows = [(i, " ".join(rng.choice(make[k], 12)), k) for i, k in enumerate(["aa", "bb"] * 30)]
    df = spark.createDataFrame([*rows, (100, None, None), (101, "123 !", "aa"), (102, "yuqsx", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, language_id.learned(df)).collect()}
    assert all(got[i] == k for i, _, k in rows) and (got[100], got[101], got[102]) == ("und", "und", "bb")
    none = language_id.identify(df, language_id.learned(df.where("lang IS NULL")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_licences(docs):
    assert licenses.evaluated("(MIT OR GPL-2.0) AND BSD-3-Clause") == ("mit gpl-2.0 or bsd-3-clause and", ["mit", "gpl-2.0", "bsd-3-clause"], True)
    assert licenses.evaluated("MIT OR GPL-2.0 AND LGPL-2.1")[2] and not licenses.evaluated("(MIT OR GPL-2.0) AND LGPL-2.1")[2]
    assert licenses.evaluated("GPL-2.0 WITH Classpath-exception-2.0 */") == ("gpl-2.0 classpath-exception-2.0 with", ["gpl-2.0"], False)
    assert licenses.evaluated("MIT AND") is licenses.evaluated("(MIT") is licenses.evaluated("") is None
    assert [licenses.family(x) for x in ("mit", "mit-0", "mitre-foo", "iscx", "gplv3", "gpl2", "apache-2.0", "cc-by-sa-4.0", "cc-by-4.0")] == ["mit", "mit", "mitre-foo", "iscx", "gpl", "gpl", "apache", "cc-by-sa", "cc-by"]
    got = licenses.scan("x MIT License, mit-license; GNU General Public License\n# SPDX-License-Identifier: MIT OR Apache-2.0")
    assert got[:6] == (17, 3, 1, 5, "gpl,mit", "apache,gpl,mit") and got[7] == 1.0
    assert licenses.scan(None) == (0, 0, None, None, "", "", [], 0.0)
    assert licenses.scan_licenses(docs).count() == len(TEXTS)


def test_long_licence_expressions_lose_nothing():
    many = " OR ".join(f"lic-{i}" for i in range(100))
    labels = set(licenses.scan(f"SPDX-License-Identifier: ({many}) WITH some-exception")[5].split(","))
    assert labels == {f"lic-{i}" for i in range(100)}
    pairs = " AND ".join(f"(a{i} OR b{i})" for i in range(5000))
    assert len(licenses.scan(f"SPDX-License-Identifier: {pairs}")[5].split(",")) == 10_000
    assert licenses.evaluated("(" * 3000 + "mit" + ")" * 3000)[1] == ["mit"]


def test_licence_places_equal_brute_force():
    rng = np.random.default_rng(4)
    parts = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "Mit", "LICENSE", "é", "cc-by", ",", "\n", "İ"]
    for _ in range(400):
        text = " ".join(rng.choice(parts, int(rng.integers(0, 30))))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        places = []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert licenses.scan(text)[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places})))


def test_html(spark):
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><div class=ad>buy</div>{body}<footer>foot</footer></body></html>"
    article = "<article><h1>Head &amp; more</h1><p><b>First\n  part<br><p>Second &eacute;<div class='comments'><p>a comment</div><p>Last</article>"
    pages = [(i, "u", page(article)) for i in range(30)] + [(90, None, None), (91, "u", ""), (92, "u", "<!-- open <p>x"), (93, "u", "<div>" * 5000 + "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_extract.extract(df, html_extract.train(df), ["page_id", "url"]).collect()}
    assert out[0] == "Head & more\n\nFirst part\n\nSecond é\n\nLast" and out[90] == out[91] == out[92] == ""


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for df in (simhash.near_duplicates(none), packing.pack_documents(none), licenses.scan_licenses(none), token_counts.token_table(none, tokenizer_path()), quality.judged(none.drop("score")), language_id.identify(none, None)):
        assert df.count() == 0
    assert url_filter.filtered_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_token_files_of_no_rows(spark, docs, tmp_path):
    token_store.write_tokens(docs.where("false"), str(tmp_path / "e"), tokenizer_path(), end_id=2)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_packing_deals_repeated_rows_apart(spark, monkeypatch):
    from quern.llm import packing

    monkeypatch.setattr(packing, "GROUP", 64)
    parts = spark.range(0, 1000).selectExpr("7L doc_id", "0 piece", "0L start", "300L length", "5L ids_crc32")
    out = packing.packed(parts).toPandas()
    sizes = (out["sequence_id"] // 2**32).value_counts()
    assert len(out) == 1000 and len(sizes) == 16 and sizes.max() < 128
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, rows in out.groupby("sequence_id"):
        assert sorted(rows["offset"]) == list(range(0, 300 * len(rows), 300))
