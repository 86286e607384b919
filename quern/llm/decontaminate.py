"""Operator 2, benchmark decontamination: test items are found inside long documents by containment.

An item is contained in a document if the document has at least ``least`` (0.8) of the
item's distinct word shingles. Items are partitioned by size: an item with u
shingles keeps as its MinHash sketch the u - ceil(least * u) + 1 smallest hashes
among its shingles. A document that lacks them all has fewer than
``least`` of the item, so looking up a document's shingles in the sketches misses
nothing, and long documents cost no more than one look-up for each shingle. What is
found is verified by exact containment of the shingles themselves.

Words are runs of letters and digits, lower-cased; shingles have five words, items of fewer words
are one shingle of their own length. The items go to every executor while their texts have at most
``MOST_ITEM_BYTES``; beyond it the sketches and the documents' hashes meet in a join, and so do
the exact shingles.

Null or wordless items are in nothing, null texts hold nothing. Repeated documents are searched one by one;
repeated items are reported each. Null ids are kept as they are. Texts of any length are searched whole; a containment of
exactly ``least`` counts; empty tables on either side give no row. Only ids and texts are read of the inputs, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_arrow, small_batches, written

WORDS = re.compile(r"[^\W_]+")
SHINGLE, LEAST = 5, 0.8
#: Items up to which their texts go to every executor: 3.3 MB of them took 123 MB in a worker.
MOST_ITEM_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash; holds a bounded number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
        if len(self) < 200_000:
            self[word] = value
        return value


_hashes = WordHashes()


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ one[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def size_of(words: list[str]) -> int:
    return min(SHINGLE, len(words))


def sketch_of(words: list[str], least: float) -> list[int]:
    """The smallest hashes of the item, as many as make a miss of all of them rule the item out."""
    distinct = np.unique(shingle_hashes(words, size_of(words)))
    return distinct[: len(distinct) - math.ceil(least * len(distinct) - 1e-9) + 1].tolist()


class Items:
    """The items, their sketches by shingle size, and their exact shingles."""

    def __init__(self, rows: list[tuple], least: float):
        self.least = least
        self.names, self.shingles = [], []
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in rows:
            words = words_of(text)
            if not words:
                continue
            size = size_of(words)
            for h in sketch_of(words, least):
                found[size][h].append(len(self.names))
            self.names.append(name)
            self.shingles.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
        self.sketches = [(size, np.array(sorted(by), np.uint64), by) for size, by in found.items()]

    def search(self, text: str | None) -> list[tuple]:
        """(item, shared shingles, containment) of every contained item."""
        words = words_of(text)
        out = []
        for size, keys, by in self.sketches:
            hashes = shingle_hashes(words, size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hits = np.unique(hashes[keys[at] == hashes]).tolist()
            candidates = {k for h in hits for k in by[h]}
            if candidates:
                own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
                for k in sorted(candidates):
                    shared = len(self.shingles[k] & own)
                    if shared >= self.least * len(self.shingles[k]) - 1e-9:
                        out.append((self.names[k], shared, shared / len(self.shingles[k])))
        return out


def contained_items(docs: DataFrame, items: DataFrame, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, shared, containment) of every item in every document."""
    chosen = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text"))
    bytes_of = chosen.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if bytes_of > MOST_ITEM_BYTES:
        return _joined(docs, chosen, least, id_column, text_column, item_column)
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])
    held: list[Items] = []

    def run(rows: dict[str, list]) -> dict[str, list]:
        if not held:
            held.append(Items(sent.value, least))
        found = [(name, *hit) for name, text in zip(rows["id"], rows["text"], strict=True) for hit in held[0].search(text)]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return dict(zip((id_column, item_column, "shared", "containment"), map(list, columns), strict=True))

    kinds = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, f"{id_column} {kinds[0]}, {item_column} {kinds[1]}, shared long, containment double")


def _joined(docs: DataFrame, items: DataFrame, least: float, id_column: str, text_column: str, item_column: str) -> DataFrame:
    """The same by joins, for items of any number: sketches meet document hashes, then shingles meet shingles."""
    items = written(items.withColumn("k", F.xxhash64("item", "text", F.monotonically_increasing_id())), "items")
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("d", F.xxhash64("id", "text", F.monotonically_increasing_id()))
    docs = written(docs, "texts")

    def sketch(rows: dict[str, list]) -> dict[str, list]:
        found = [(k, size_of(w), h) for k, t in zip(rows["k"], rows["text"], strict=True) if (w := words_of(t)) for h in np.array(sketch_of(w, least), np.uint64).view(np.int64).tolist()]
        return dict(zip(("k", "size", "h"), map(list, list(zip(*found, strict=True)) or [[]] * 3), strict=True))

    sketches = written(map_arrow(items, ["k", "text"], sketch, "k long, size int, h long"), "item-sketches")
    sizes = sorted(r["size"] for r in sketches.select("size").distinct().collect())

    def probe(rows: dict[str, list]) -> dict[str, list]:
        found = [(d, s, h) for d, t in zip(rows["d"], rows["text"], strict=True) for w in [words_of(t)] for s in sizes for h in np.unique(shingle_hashes(w, s)).view(np.int64).tolist()]
        return dict(zip(("d", "size", "h"), map(list, list(zip(*found, strict=True)) or [[]] * 3), strict=True))

    probes = map_arrow(docs, ["d", "text"], probe, "d long, size int, h long")
    pairs = probes.join(sketches, ["size", "h"]).select("d", "k").distinct()
    both = pairs.join(docs, "d").join(items.withColumnRenamed("text", "item_text"), "k")

    def verify(rows: dict[str, list]) -> dict[str, list]:
        found = []
        for name, text, item, item_text in zip(rows["id"], rows["text"], rows["item"], rows["item_text"], strict=True):
            found += [(name, item, *hit[1:]) for hit in Items([(0, item_text)], least).search(text)]
        return dict(zip((id_column, item_column, "shared", "containment"), map(list, list(zip(*found, strict=True)) or [[]] * 4), strict=True))

    kinds = docs.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    return map_arrow(both, ["id", "text", "item", "item_text"], verify, f"{id_column} {kinds[0]}, {item_column} {kinds[1]}, shared long, containment double")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that contain no item, with their own columns; each text is judged where it is while the items can be sent."""
    chosen = items.select("item_id", "text")
    bytes_of = chosen.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if bytes_of > MOST_ITEM_BYTES:
        keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")  # ids may be null or repeated
        bad = contained_items(keyed, items, least, id_column="__row").select("__row").distinct()
        return keyed.join(bad, "__row", "left_anti").select(*docs.columns)
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])
    held: list[Items] = []

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        if not held:
            held.append(Items(sent.value, least))
        return pd.Series([not held[0].search(t) for t in texts], dtype=bool)

    return docs.where(clean(F.col("text")))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
