"""Operator 5, SimHash near-duplicates: 64-bit fingerprints compared bit plane by bit plane.

``fingerprints`` gives one fingerprint per row; ``link_classes`` links fingerprints
within a radius and gives the class of every row.  Rows with the same fingerprint
are one node first (a partial aggregate: a hot group of copies shrinks where it is).
Nodes meet in buckets of equal bits, complete by the pigeonhole principle: of eight blocks of
8 bits a pair within radius 2 shares six, so there are 28 tables of buckets, and a
bucket has 16 bits left to differ in: at most 65,536 fingerprints, whatever the input. In a
bucket the fingerprints stand as 64 vertical bit planes, 64
fingerprints to a machine word: each query adds the differing planes into
carry-save counters, for 64 distances at once, and a block is abandoned
once all its distances exceed the radius. What a bucket hands on is a spanning forest of its links.

A class is named by the smallest id in it. Rows with a null id link like any other (a class of
nothing else has the name null); rows of the same id are each returned. Null texts and texts without
words have fingerprint zero and link like any other. Empty tables give empty results.

``keep_one_of_each`` takes one row of each class of texts alike in their word shingles; see there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import ASCII_LOWER, discard, map_arrow, sent_if_small, small_batches, written
from .components import components

#: The white space of the word rule; ``split()`` knows more of it.
_SPACES = {c: " " for c in range(9, 14)}
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; fewer words: of them all; none: nothing."""
    import xxhash

    words = [w for w in text.translate(ASCII_LOWER).translate(_SPACES).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    whole = " ".join(words).encode("utf-8", "replace")
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    lengths = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "replace")) for w in words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    stops = ends[size - 1 :].tolist()
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(text: str | None, size: int) -> int:
    return fingerprint_of(shingle_hashes(text or "", size))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {id_column: rows["id"], "fp": [fingerprint(t, size) for t in rows["text"]]}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, f"{id_column} {kind}, fp long")


# -- buckets ---------------------------------------------------------------------------------------------------------

#: Blocks that the 64 bits are cut into for a complete search, and the largest radius that it serves.
BLOCKS, MOST_RADIUS = 8, 2


def bucket_masks(radius: int) -> list[int]:
    """Bit masks of the bucket tables: all choices of ``BLOCKS`` - ``radius`` blocks, one of which any pair within the radius shares."""
    if radius > MOST_RADIUS:
        raise ValueError(f"complete bucket tables serve a radius of {MOST_RADIUS} at most")
    blocks = [int(sum(1 << int(b) for b in part)) for part in np.array_split(np.arange(64), BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# -- bit-sliced comparison -------------------------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """[blocks, 64 bits] words of [blocks, 64] fingerprints: word (k, b) holds bit b of the block's 64 fingerprints."""
    bits = (fps[:, None, :] >> np.arange(64, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    return np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=2)


def within_radius(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """[blocks, queries] words: bit m is set if member m of the block is within ``radius`` of the query.

    Carry-save counters: two planes and the counter's lowest digit go into a full
    adder, whose carries climb through the higher digits; what leaves the top digit
    stays in ``over``. Blocks whose distances all exceed the radius are left out from there on.
    """
    digits = max(1, radius.bit_length())
    result = np.zeros(queries.shape, np.uint64)
    live = np.arange(len(planes))
    zero = lambda: np.zeros((len(live), queries.shape[1]), np.uint64)
    count, over = [zero() for _ in range(digits)], zero()
    q = queries
    p = planes
    for b in range(0, 64, 2):
        one, two = (p[:, b + k, None] ^ (np.uint64(0) - ((q >> np.uint64(b + k)) & np.uint64(1))) for k in (0, 1))
        mixed = one ^ two
        carry = (one & two) | (mixed & count[0])
        count[0] = count[0] ^ mixed
        for d in range(1, digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b % 8 == 6:
            alive = (~(over | _above(count, radius))).any(axis=1)
            if not alive.all():
                live, p, q, over = live[alive], p[alive], q[alive], over[alive]
                count = [c[alive] for c in count]
                if not len(live):
                    return result
    result[live] = ~(over | _above(count, radius))
    return result


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter exceeds ``radius``."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            equal = equal & count[d]
        else:
            above |= equal & count[d]
            equal = equal & ~count[d]
    return above


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of index pairs, as (node, root) with the smallest index as root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _small_buckets(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs within the radius in buckets of at most 64 rows, all buckets of like size at once."""
    out = []
    for top in (2, 4, 8, 16, 32, 64):
        chosen = np.flatnonzero((sizes <= top) & (sizes > top // 2) & (sizes > 1))
        step = max(1, (1 << 17) // top)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            slot = np.arange(64)
            real = slot[None, :] < sizes[part, None]
            index = np.where(real, starts[part, None] + slot[None, :], starts[part, None])
            members = fps[index]
            near = within_radius(bit_planes(members), members[:, :top], radius)
            bits = np.unpackbits(near.view(np.uint8).reshape(len(part), top, 8), axis=2, bitorder="little").astype(bool)
            bits &= real[:, None, :] & real[:, :top, None] & (slot[None, None, :] > np.arange(top)[None, :, None])
            k, i, j = np.nonzero(bits)
            out.append(np.stack([index[k, i], index[k, j]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _large_bucket(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[np.ndarray]:
    """Index pairs (into left, into right) within the radius of two large sets, 64 members of ``right`` to a word."""
    for at in range(0, len(right), 64):
        part = right[at : at + 64]
        block = np.concatenate([part, np.full(64 - len(part), part[0], np.uint64)])
        planes = bit_planes(block[None, :])
        rows = left[: at + 64] if same else left
        for r in range(0, len(rows), 1024):
            near = within_radius(np.broadcast_to(planes, (len(q := rows[r : r + 1024]), 64)), q[:, None], radius)
            bits = np.unpackbits(near.view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little").astype(bool)[:, : len(part)]
            i, j = np.nonzero(bits)
            i, j = i + r, j + at
            keep = i < j if same else np.ones(len(i), bool)
            yield np.stack([i[keep], j[keep]], 1)


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Index pairs within the radius of rows sorted by bucket; all pairs of a bucket of more than 64 rows follow one another."""
    if not len(fps):
        return
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    small = sizes <= 64
    yield _small_buckets(fps, starts[small], sizes[small], radius)
    for start, n in zip(starts[~small], sizes[~small], strict=True):
        own = fps[start : start + n]
        for found in _large_bucket(own, own, radius, True):
            yield found + start


def spanning_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """Links (as index pairs, a forest of each bucket) that connect what lies within the radius in a bucket."""
    held = np.zeros((0, 2), np.int64)
    for found in near_pairs(fps, bucket, radius):
        held = np.concatenate([held, found])
        if len(held) > 1 << 16:
            held = np.array(_forest(held), np.int64).reshape(-1, 2)
    return np.array(_forest(held), np.int64).reshape(-1, 2)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first column, cut so that no value of it is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:  # a bucket may go on in the next batch: what it has so far waits
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]  # binary ones as objects
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [r[:cut] for r in rows], strict=True)]
            held = []
        held.append([r[cut:] for r in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def linked(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` of ``nodes`` that lie within ``radius`` bits, enough to connect each class."""
    ship_package(nodes.sparkSession)
    masks = [F.lit(_signed(m)).cast("long") for m in bucket_masks(radius)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(m)) for t, m in enumerate(masks)]))
    dealt = nodes.select(keys.alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp in whole_buckets(batches):
            found = spanning_links(fp.view(np.uint64), bucket, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def link_classes(prints: DataFrame, radius: int = 2, id_column: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): the smallest id that the row's fingerprint reaches over links of at most ``radius`` bits.

    ``prints`` is (id, fp); it is read twice, so hand in a written table. Fingerprints are the nodes, so
    rows of one id with two fingerprints don't join their classes.
    """
    nodes = written(prints.groupBy("fp").agg(F.min(id_column).cast("long").alias("least")), "nodes")
    roots = components(linked(nodes, radius))
    placed = nodes.join(sent_if_small(roots), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(names, "root").select("fp", "component_id"), "named")
    discard(nodes, roots, placed)
    return prints.join(named, "fp").select(id_column, "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    return link_classes(written(fingerprints(docs, size), "prints"), radius)


# -- one document of each class, by verified similarity --------------------------------------------------------------

#: Bands of minimal hashes: a pair of similarity s shares a band with a chance of 1 - (1 - s**4)**16, 0.9998 at 0.8.
BANDS, BAND_ROWS = 16, 4
_SEEDS, _FACTORS = (np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1))
#: Bits within which texts of a similarity of 0.8 lie: 99 of 100 simulated pairs at each of seven lengths did, and nearly all above 0.8.
RADIUS = 16
#: Bands that a pair must share outside its bucket's leader: at 0.8 all but 3 in 1,000 share two (computed).
LEAST_BANDS = 2
#: Members and shingles up to which a bucket is compared in full at once (8 bytes a shingle stay in one task's memory); larger ones are split, see ``by_prefix`` and ``in_parts``.
CHUNK, MOST_SHINGLES = 2048, 1 << 22
#: Counters of the sketch that orders shingles by how often they occur, sent to every task (4 bytes each).
COUNTERS = 1 << 20
#: Pairs with one leader that go to one task; more are dealt out.
HOT = 1000


def band_keys(distinct: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the least hashes of a set of shingle hashes; none for no shingle."""
    import xxhash

    if not len(distinct):
        return []
    least = np.full(BANDS * BAND_ROWS, ALL)
    for at in range(0, len(distinct), 1024):
        mixed = (distinct[None, at : at + 1024] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def verified(pairs: DataFrame, rows: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (a, b) of row keys whose sets of shingles of ``size`` words have a similarity of ``least`` or more; a stored table.

    ``rows`` is (row, text). Only rows that occur in a pair are read into sets.
    """
    pairs = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    named = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "named")
    sets = written(shingle_sets(rows, named, size), "sets")
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot")
    part = F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    salted = pairs.join(sent_if_small(hot), "b", "left").select("a", "b", part)
    heads = sets.select(F.col("row").alias("b"), F.col("s").alias("sb")).join(sent_if_small(hot), "b", "left")
    heads = heads.select("b", "sb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = salted.join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a").join(heads, ["b", "part"])

    def run(batch: dict[str, list]) -> dict[str, list]:
        good = [k for k, (x, y) in enumerate(zip(batch["sa"], batch["sb"])) if similarity(x, y) >= least - 1e-9]
        return {c: [batch[c][k] for k in good] for c in "ab"}

    out = written(map_arrow(both, ["a", "b", "sa", "sb"], run, "a long, b long"), "links")
    discard(pairs, named, sets, hot)
    return out


def _alike(fp: str, n: str, other_fp: str, other_n: str, radius: int, least: float):
    """Whether two nodes may have a similarity of ``least``: by their fingerprints, and by their numbers of shingles."""
    close = F.bit_count(F.col(fp).bitwiseXOR(F.col(other_fp))) <= radius
    return close & (F.least(n, other_n) >= least * F.greatest(n, other_n))


def shingle_sets(rows: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(row, s) of the rows of ``rows`` (row, text) that occur in ``named`` (row, stored): their distinct shingle hashes in order, 8 bytes each."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"row": batch["row"], "s": [np.unique(shingle_hashes(t or "", size)).tobytes() for t in batch["text"]]}

    return map_arrow(rows.join(sent_if_small(named), "row", "left_semi"), ["row", "text"], run, "row long, s binary")


def similarity(a: bytes, b: bytes) -> float:
    """Of two sets of hashes in order; of two empty ones 1."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    shared = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
    return shared / (len(one) + len(two) - shared)


def linked_in_buckets(mixed: DataFrame, nodes: DataFrame, rows: DataFrame, least: float, size: int, radius: int) -> DataFrame:
    """Links (a, b) that connect the nodes of different roots in one bucket of ``mixed`` (key, band, t, node, fp, n, root), a stored table.

    Pairs within the radius are verified by their shingles where they meet, unless what is verified before connects them already; so only
    a spanning forest leaves the bucket. In buckets of bands (``t`` below 0) they must share ``LEAST_BANDS`` of these, and meet in the first one's.
    """
    ship_package(mixed.sparkSession)
    small_batches(mixed.sparkSession)
    named = written(mixed.select(F.col("node").alias("row")).distinct(), "named")
    sets = written(shingle_sets(rows, named, size).withColumnRenamed("row", "node"), "sets")
    full = mixed.join(nodes.select("node", "sig"), "node").join(sets, "node")
    dealt = full.select("key", "node", "fp", "n", "root", "t", "band", "sig", "s").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp, n, root, t, band, sig, s in whole_buckets(batches):
            bands = np.frombuffer(b"".join(sig), np.int32).reshape(-1, BANDS)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            links: list[tuple[int, int]] = []
            for found in near_pairs(fp.view(np.uint64), key, radius):
                a, b = found[:, 0], found[:, 1]
                keep = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
                a, b = a[keep], b[keep]
                same = bands[a] == bands[b]
                keep = (t[a] >= 0) | (same.sum(1) >= LEAST_BANDS) & (same.argmax(1) == band[a])
                for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                    one, two = top(int(root[i])), top(int(root[j]))
                    if one != two and similarity(s[i], s[j]) >= least - 1e-9:
                        parent[max(one, two)] = min(one, two)
                        links.append((i, j))
            if links:
                pairs = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    out = written(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(named, sets)
    return out


def prefix_of(s: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """(the rarest of a set's hashes by ``counts`` (of their residues), how many of them lead); equal counts go by hash.

    Whatever the order, two sets of similarity ``least`` share a hash that is among the first ``(1 - least) * n + 1`` of the larger one and
    among the first ``(1 - 2 * least / (1 + least)) * n + 1``, the leading ones, of the smaller one: otherwise what is left is too little.
    """
    n = len(s)
    size, lead = (n - int(np.ceil(share * n - 1e-9)) + 1 for share in (least, 2 * least / (1 + least)))
    return s[np.lexsort((s, counts[(s % np.uint64(len(counts))).astype(np.int64)]))[:size]], lead


def by_prefix(large: DataFrame, rows: DataFrame, least: float, size: int) -> DataFrame:
    """Members (key, band, node, fp, n, t) of too large buckets of bands, in buckets of one rare shingle each, so that no pair of similarity ``least`` is lost.

    What many of the members share, such as a passage of all their texts, comes last in the order and makes no bucket.
    """
    only = written(large.select("node", "fp", "n").dropDuplicates(["node"]), "crowded")
    sets = written(shingle_sets(rows, only.select(F.col("node").alias("row")), size), "sets")

    def counted(batch: dict[str, list]) -> dict[str, list]:
        found = np.frombuffer(b"".join(batch["s"]), np.uint64) % np.uint64(COUNTERS)
        residues, times = np.unique(found.astype(np.int64), return_counts=True)
        return {"residue": residues.tolist(), "times": times.tolist()}

    seen = map_arrow(sets, ["s"], counted, "residue int, times long").groupBy("residue").agg(F.least(F.sum("times"), F.lit((1 << 31) - 1)).cast("int").alias("times")).toPandas()
    counts = np.zeros(COUNTERS, np.int32)  # at most one row for each counter comes back
    counts[seen["residue"].to_numpy(int)] = seen["times"]
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def chosen(batch: dict[str, list]) -> dict[str, list]:
        found = [prefix_of(np.frombuffer(s, np.uint64), sent.value, least) for s in batch["s"]]
        return {"node": batch["row"], "keys": [x.view(np.int64).tolist() for x, _ in found], "lead": [n for _, n in found]}

    keys = map_arrow(sets, ["row", "s"], chosen, "node long, keys array<bigint>, lead int").select("node", "lead", F.posexplode("keys").alias("place", "key"))
    keys = written(keys.select("node", "key", (F.col("place") < F.col("lead")).alias("leads")), "keys")
    met = keys.groupBy("key").agg(F.count("*").alias("size"), F.max("leads").alias("leads")).where("size > 1 AND leads").select("key")
    met = written(met, "met")  # buckets in which a pair can be
    members = keys.join(sent_if_small(met), "key", "left_semi").join(only, "node")
    members = written(members.select("key", F.lit(0).alias("band"), "node", "fp", "n", F.lit(0).alias("t")), "members")
    discard(only, sets, keys, met)
    return members


def in_parts(large: DataFrame) -> DataFrame:
    """Members of buckets that are still too large, in a bucket for each two of their parts, so that every pair meets."""
    parts = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("mass") / MOST_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = large.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    return written(each.select(key, "band", "node", "fp", "n", F.lit(1).alias("t")), "members")


def similar_nodes(nodes: DataFrame, rows: DataFrame, least: float, size: int, radius: int) -> DataFrame:
    """(node, root) of every node that is alike with another; ``nodes`` is a stored table (node, fp, n, bands, sig)."""
    members = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "fp", "n", F.lit(-1).alias("t"))
    links = None
    for split in (by_prefix, in_parts, None):
        heads = members.groupBy("key").agg(F.min("node").alias("head"), F.min_by("fp", "node").alias("head_fp"), F.min_by("n", "node").alias("head_n"), F.count("*").alias("size"), F.sum("n").alias("mass"))
        heads = written(heads.where("size > 1"), "heads")
        crowd = written(members.join(heads, "key"), "crowd")
        stars = crowd.where((F.col("node") != F.col("head")) & _alike("fp", "n", "head_fp", "head_n", radius, least)).select(F.col("node").alias("a"), F.col("head").alias("b"))
        found = verified(stars, rows, least, size)
        links = found if links is None else links.union(found)
        roots = components(links)
        placed = written(crowd.join(sent_if_small(roots), "node", "left").select("key", "band", "node", "fp", "n", "t", "size", "mass", F.coalesce("root", "node").alias("root")), "placed")
        apart = written(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "apart")
        mixed = written(placed.join(sent_if_small(apart), "key", "left_semi"), "mixed")
        fits = (F.col("size") <= CHUNK) & ((F.col("mass") <= MOST_SHINGLES) | (F.col("size") <= 2)) if split else F.lit(True)
        small = written(mixed.where(fits).drop("size", "mass"), "small")
        more = linked_in_buckets(small, nodes, rows, least, size, radius)
        discard(heads, crowd, placed, apart, small)
        large = mixed.where(~fits)
        if large.isEmpty():
            return roots if more.isEmpty() else components(links.union(more))
        links = links.union(more)
        members = by_prefix(large, rows, least, size) if split is by_prefix else in_parts(large)
        discard(mixed)


def keep_one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents without their near-copies: of each class one row stays, that with the smallest id, null ids last.

    Two texts are linked if their sets of shingles of ``size`` words have a similarity of ``least`` or more, and
    a class is what chains of links reach. Rows with equal sets are one node. Nodes meet in buckets that share a
    band of minimal hashes, since sampled bits of the fingerprint miss too many pairs at 0.8; there their
    fingerprints (of the distinct shingles) are compared bit plane by bit plane, and what lies within ``radius`` bits (and shares a second band,
    unless one of the two leads the bucket) is verified by the shingles themselves. Each bucket first meets its smallest node; where it
    still holds several classes, its members are compared in full, at most ``CHUNK`` of them. The members of larger buckets meet again
    for each of their rarest shingles, as many as make a miss impossible, and what is too large even then in parts, two at a time: no split loses a pair within ``radius`` bits.

    Rows are told apart by a key written with them, so that rows with the same id or none are judged like any other.
    Null texts and texts without words are one class. The columns stay as they are, whatever their names.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: c for c, name in reversed(list(zip(columns, docs.columns, strict=True)))}
    keyed = written(docs.toDF(*columns).withColumn("row", F.monotonically_increasing_id()), "keyed")
    rows = keyed.select("row", F.col(at["doc_id"]).alias("id"), F.col(at["text"]).alias("text"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        import xxhash

        sets = [np.unique(shingle_hashes(t or "", size)) for t in batch["text"]]
        digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
        bands = [band_keys(s) for s in sets]
        return {"row": batch["row"], "id": batch["id"], "fp": [fingerprint_of(s) for s in sets], "n": [len(s) for s in sets], "digest": digests, "bands": bands, "sig": [np.array(b, np.int64).astype(np.int32).tobytes() for b in bands]}

    kind = rows.schema["id"].dataType.simpleString()
    prints = written(map_arrow(rows, ["row", "id", "text"], run, f"row long, id {kind}, fp long, n long, digest binary, bands array<bigint>, sig binary"), "prints")
    nodes = prints.groupBy("digest").agg(F.min("row").alias("node"), F.min_by(F.struct("fp", "n", "bands", "sig"), "row").alias("of"), F.count("*").alias("copies"))
    nodes = written(nodes.select("digest", "node", "copies", "of.*"), "nodes")
    roots = similar_nodes(nodes, rows.select("row", "text"), least, size, radius)
    named = nodes.join(sent_if_small(roots), "node", "left").where("copies > 1 OR root IS NOT NULL").select("digest", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    inside = written(prints.join(named, "digest").select("root", "row", rank.alias("rank")), "inside")
    stays = written(inside.groupBy("root").agg(F.min("rank").alias("best")), "stays")
    gone = written(inside.join(stays, "root").where(F.col("row") != F.col("best.row")).select("row"), "gone")
    discard(prints, nodes, roots, named, inside, stays)
    return keyed.join(sent_if_small(gone), "row", "left_anti").select(*columns).toDF(*docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
