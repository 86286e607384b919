"""Operator 11, periodic runs: tandem repeats by leftmost-covering squares and suffix-tree walks, merged into maximal runs.

Words are symbols. A run of at least ``min_length`` words and ``min_exponent`` periods is covered by stretches of
``min_length * (min_exponent - 1) / min_exponent`` words that occur twice, so only stretches covered by such repeats are searched; a run
lies within one of them, with its ends. In each:

1. The text is cut into LZ blocks. Extensions to both sides of each block's ends give a set of squares
   (start, 2 * period) that covers, by rotation to the right, the first place of every square.
2. These are marked in the suffix tree where they end. From each mark the walk drops the first symbol along the
   suffix link and appends it again, as long as the rotation occurs and is unmarked: then every distinct square is marked.
3. Marks are located by their leaves, and squares of one period at consecutive starts merge into a run.

Squares whose root is itself a repetition are left out between 1 and 2, as their runs have a smaller period. Extensions are
looked up in the ranks of all stretches of 2, 4, 8, ... words, which also sort the suffixes, so time is within a
logarithm of the stretch's length and memory holds that many ranks for each of its words.

Null and empty texts have no words and no runs. Each row is searched whole, in one task, so repeated rows and null ids give a row each.
Two runs of different periods may overlap; runs of equal strength go to the smaller start, then the smaller period. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_arrow

#: An odd multiplier for hashes of word stretches.
MIX = 0x9E3779B97F4A7C15


def repeated_stretches(hashes: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """The maximal stretches [a, b) covered by ``gram`` words that occur more than once; equal hashes count as equal words."""
    n = len(hashes) - gram + 1
    if n < 2:
        return []
    h, width, mix = hashes, 1, MIX
    while 2 * width <= gram:
        h = h[:-width] * np.uint64(mix) + h[width:]
        width, mix = 2 * width, mix * mix % (1 << 64)
    if width < gram:
        h = h[:n] * np.uint64(mix) + h[gram - width : gram - width + n]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, np.unique(twice)))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + gram, -1)
    inside = np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8)
    turns = np.diff(inside)
    return list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))


class Ranks:
    """Ranks of the stretches of 1, 2, 4, ... symbols, the suffix order, and extensions of pairs of places."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = []
        width = 1
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if rank.max() == n - 1:
                break
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal; a and b differ."""
        start, a, b = a, a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are equal."""
        start, a, b = a, a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            level = self.levels[k]
            step = ((np.minimum(x, y) >= 0) & (level[np.maximum(x, 0)] == level[np.maximum(y, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a


def lz_blocks(ranks: Ranks) -> np.ndarray:
    """Starts of the blocks: each is the longest stretch that also starts earlier, or one new symbol."""
    n, order = ranks.n, ranks.order.tolist()
    before, behind = [-1] * n, [-1] * n  # of each place: the nearest smaller ones in suffix order
    stack: list[int] = []
    for place in order:
        while stack and stack[-1] > place:
            behind[stack.pop()] = place
        if stack:
            before[place] = stack[-1]
        stack.append(place)
    longest = np.zeros(n, np.int64)
    for other in (np.array(before), np.array(behind)):
        at = np.flatnonzero(other >= 0)
        longest[at] = np.maximum(longest[at], ranks.forward(at, other[at]))
    steps, at, starts = np.maximum(longest, 1).tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    return np.array(starts)


def covering_squares(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of squares that cover the first place of each square by rotations to the right."""
    n = ranks.n
    h = lz_blocks(ranks)
    h1 = np.append(h[1:], n)
    h2 = np.append(h1[1:], n)

    def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block and the period of each trial: 1 to ``sizes`` of each block."""
        block = np.repeat(np.arange(len(sizes)), sizes)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

    # all in the block up to its second half, found at the block's end
    block, k = counted(np.where(h1 < n, h1 - h, 0))
    end, q = h1[block], h1[block] - k
    right, left = ranks.forward(end, q), ranks.backward(end, q)
    good = (right + left >= k) & (right > 0)
    found = [(np.maximum(q - left, q - k + 1)[good], k[good])]
    # it starts before the block and its first half ends within, found at the block's start
    block, k = counted(h2 - h)
    inside = h[block] + k < n
    block, k = block[inside], k[inside]
    begin, q = h[block], h[block] + k
    right, left = ranks.forward(begin, q), ranks.backward(begin, q)
    start = np.maximum(begin - left, begin - k + 1)
    good = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= h1[block])
    found.append((start[good], k[good]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def primitive(ranks: Ranks, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether a square's root is no repetition: no period of it is the root's length over a prime."""
    good = np.ones(len(starts), bool)
    if not len(starts):
        return good
    top = int(periods.max())
    least = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            part = least[p * p :: p]
            part[part > p] = np.minimum(part[part > p], p)
    rest = periods.copy()
    while (rest > 1).any():
        at = np.flatnonzero((rest > 1) & good)
        if not len(at):
            break
        prime = least[rest[at]]
        part = periods[at] // prime
        good[at[ranks.forward(starts[at], starts[at] + part) >= 2 * periods[at] - part]] = False
        rest[at] //= prime
        rest[~good] = 1
    return good


class SuffixTree:
    """The compact tree of all suffixes, each with an end mark: leaves are ranks 0 to n - 1, the root is n."""

    def __init__(self, symbols: np.ndarray, ranks: Ranks) -> None:
        n = ranks.n
        order = ranks.order
        shared = ranks.forward(order[1:], order[:-1]).tolist()
        depth, left, right, parent = (n - order + 1).tolist(), list(range(n)), list(range(n)), [n] * n
        depth.append(0), left.append(0), right.append(n - 1), parent.append(n)
        stack = [n, 0]  # the path to the last leaf
        for leaf, d in enumerate(shared, 1):
            last = stack.pop()
            while depth[stack[-1]] > d:
                parent[last] = stack[-1]
                last = stack.pop()
                right[last] = leaf - 1
            if depth[last] > d > depth[stack[-1]]:
                node = len(depth)
                depth.append(d), left.append(left[last]), right.append(leaf - 1), parent.append(n)
                parent[last] = node
                stack.append(node)
            else:
                parent[last] = stack[-1]
            stack.append(leaf)
        while len(stack) > 1:
            last = stack.pop()
            parent[last] = stack[-1]
            right[last] = n - 1
        right[: n + 1] = [*range(n), n - 1]
        self.n, self.root = n, n
        self.depth, self.left, self.right, self.parent = map(np.array, (depth, left, right, parent))
        self.above = [self.parent]  # 1, 2, 4, ... nodes above
        while (self.above[-1] != n).any():
            self.above.append(self.above[-1][self.above[-1]])
        inner = np.arange(n + 1, len(depth))
        self.link = np.full(len(depth), n)
        self.link[inner] = self.at(ranks.rank[np.minimum(order[self.left[inner]] + 1, n - 1)], self.depth[inner] - 1)
        self.symbols = [*symbols.tolist(), -1]
        self.first = order[self.left].tolist()  # a place of each node's string
        self.kinds = int(symbols.max()) + 1
        node = np.flatnonzero(np.arange(len(depth)) != n)
        edge = order[self.left[node]] + self.depth[self.parent[node]]
        node, edge = node[edge < n], edge[edge < n]
        self.child = dict(zip((self.parent[node] * self.kinds + symbols[edge]).tolist(), node.tolist(), strict=True))

    def at(self, leaves: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The node at or below the place where the leaves' first ``depths`` symbols end."""
        for up in reversed(self.above):
            higher = up[leaves]
            leaves = np.where(self.depth[higher] >= depths, higher, leaves)
        return leaves

    def completed(self, nodes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, lengths) of all rotations of the marked squares that occur, by walks along suffix links."""
        depth, parent, link = self.depth.tolist(), self.parent.tolist(), self.link.tolist()
        child, kinds, symbols, first, root = self.child, self.kinds, self.symbols, self.first, self.root
        wide = self.n + 1
        marked = set((nodes * wide + lengths).tolist())
        for mark in list(marked):
            node, length = divmod(mark, wide)
            while True:
                place = first[node]
                gone = symbols[place]
                u = link[parent[node]] if parent[node] != root else root
                at = depth[u]
                below = u
                while at < length - 1:  # down to where the rest ends
                    below = child[u * kinds + symbols[place + 1 + at]]
                    at = depth[below]
                    if at < length - 1:
                        u = below
                if at == length - 1:
                    node = child.get(below * kinds + gone, -1)
                else:
                    node = below if symbols[first[below] + length - 1] == gone else -1
                if node < 0 or (mark := node * wide + length) in marked:
                    break
                marked.add(mark)
        both = np.array(sorted(marked), np.int64)
        return both // wide, both % wide


def squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of every square with a primitive root, by period and start."""
    ranks = Ranks(symbols)
    starts, periods = covering_squares(ranks)
    good = primitive(ranks, starts, periods)
    starts, periods = starts[good], periods[good]
    if not len(starts):
        return starts, periods
    tree = SuffixTree(symbols, ranks)
    nodes, lengths = tree.completed(tree.at(ranks.rank[starts], 2 * periods), 2 * periods)
    size = tree.right[nodes] - tree.left[nodes] + 1
    leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(tree.left[nodes], size)
    key = np.sort(np.repeat(lengths // 2, size) * len(symbols) + ranks.order[leaf])
    return key % len(symbols), key // len(symbols)


def runs_of(words: list[bytes], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``min_length`` words and ``min_exponent`` periods, by start and period."""
    if len(words) < min_length:
        return []
    gram = -(-min_length * (min_exponent - 1) // min_exponent)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    found: list[tuple[int, int, int]] = []
    for a, b in repeated_stretches(hashes, gram):
        if b - a < min_length:
            continue
        names: dict[bytes, int] = {}
        symbols = np.array([names.setdefault(w, len(names)) for w in words[a:b]])
        start, period = squares(symbols)
        if not len(start):
            continue
        key = period * (b - a) + start
        first = np.flatnonzero(np.append(True, np.diff(key) != 1))
        last = np.append(first[1:], len(key)) - 1
        length = start[last] - start[first] + 2 * period[first]
        keep = length >= np.maximum(min_length, min_exponent * period[first])
        found += zip((start[first][keep] + a).tolist(), length[keep].tolist(), period[first][keep].tolist(), strict=True)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


NAMES = ("n_words", "runs", "strongest", "collapsed")
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"


def periodic_runs(docs: DataFrame, text: Column | str = "text", id_column: str = "doc_id", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """(id, n_words, runs, strongest, collapsed) of every row.

    ``runs`` is ordered by start and period, ``strongest`` the one of the greatest length over period, ``collapsed`` the text with each run cut to its first period.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has at least two words and two periods")

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = []
        for text in rows["text"]:
            words = (text or b"").split()
            runs = runs_of(words, min_length, min_exponent)
            named = [dict(zip(("start", "length", "period"), r)) for r in runs]
            best = max(range(len(runs)), key=lambda k: (Fraction(runs[k][1], runs[k][2]), -runs[k][0], -runs[k][2]), default=None)
            out.append((len(words), named, None if best is None else named[best], collapsed(words, runs).decode("utf-8")))
        return {id_column: rows["id"]} | {k: [x[i] for x in out] for i, k in enumerate(NAMES)}

    kind = docs.schema[id_column].dataType.simpleString()
    column = F.col(text) if isinstance(text, str) else text
    return map_arrow(docs, [F.col(id_column).alias("id"), column.cast("binary").alias("text")], run, f"{id_column} {kind}, {SCHEMA}")


def with_repeats(id_column: str, text_column: str) -> Column:
    """The contract's text: one row in ten, by a checksum of the id, goes on from some word with the words before over and over."""
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.expr(f"regexp_extract_all(`{text_column}`, '({WORD})', 1)".replace("\\", "\\\\"))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & F.col(text_column).rlike(WORD), changed).otherwise(F.col(text_column))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_repeats("doc_id", "text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
