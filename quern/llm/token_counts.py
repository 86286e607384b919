"""Operator 4, token counts: a table of the exact token count of every prefix of a text.

The table is built by dynamic programming over prefixes.  In byte-level BPE the
encoding of a prefix that ends at byte j is the encoding of a shorter prefix plus
one last token, and that token is the only one that ends there and stays unmerged
beside the shorter prefix's own last token.  So each prefix takes one count from an
earlier one plus one, and nothing is encoded twice.  Budget questions (how many
tokens has this prefix, how long a prefix fits N tokens) read the stored table.

Null texts count as empty: no prefix, zero bytes and tokens.  Repeated rows and
repeated ids are kept as they are; other columns of the input are not read, whatever their names.
A text of any length is counted whole, in one task, with two bytes for each of its bytes; an empty table gives none.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import larger, small_batches
from .tokens import END_TEXT, Encoder, Pieces, encoder, tokenizer_path

#: Deltas between neighbouring prefixes; a token has at most some hundred bytes, so two bytes hold any of them.
DELTA = np.dtype("<i2")
#: Pre-tokens that a cut after two letters splits in two.
CONTRACTIONS = ("'re", "'ve", "'ll")
_RUN = re.compile(r"\s\s")


class PrefixCounter(Pieces):
    """Counts of all prefixes (by code points) of a text, as differences between neighbours."""

    def __init__(self, source: Encoder, memory: int = 600_000, pairs: int = 500_000):
        import json

        super().__init__(DELTA, memory)
        self.source = source
        model = json.loads(source.library.to_str())["model"]
        self.tokens: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        self.pairs, self.most_pairs = 0, pairs
        self.apart: dict[str, dict[str, bool]] = defaultdict(dict)
        #: The word before and, for each of its prefixes, the count, the last token and what is known of that token.
        self.before, self.found = "", ([0], [""], [self.apart[""]])

    def merged(self, parts: list[str]) -> list[str]:
        """The merge rule itself, on a few letters: lowest rank first, leftmost among equals."""
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def unmerged(self, left: str, right: str) -> bool:
        """Whether no merge ever crosses the border of two tokens.

        Merges are undone from the last on: what touches the border at each moment
        is a right part of ``left`` and a left part of ``right``, and a merge of the
        two would have come first if its rank were below that of the part undone last.
        """
        rank, made = self.rank, self.made
        before = 1 << 60
        while True:
            if rank.get((left, right), 1 << 60) < before:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left = a[0], a[2]
            else:  # of equal merges the left one comes first
                before, right = b[0] + 1, b[1]

    def beside(self, left: str, right: str) -> bool:
        """Whether the token ``right`` stays whole behind ``left`` (nothing in front: always), kept in a bounded memory."""
        known = not left or self.unmerged(left, right)
        if self.pairs < self.most_pairs:
            self.pairs += 1
            self.apart[left][right] = known
        return known

    def letters(self, word: str) -> list[int]:
        """Counts of the prefixes of one pre-token given in byte letters, from 0 letters on.

        Only one token ends at each place, so the shortest candidates come first and none are tried past it.
        A prefix has its counts whatever follows, so those that the word before shares are there already.
        """
        counts, last, near = self.found
        before, same = self.before, 0
        for a, b in zip(word, before):
            if a != b:
                break
            same += 1
        del counts[same + 1 :], last[same + 1 :], near[same + 1 :]
        self.before = word[:same]
        tokens, apart = self.tokens, self.apart
        for j in range(same + 1, len(word) + 1):
            i = j
            count, own = 0, ""
            while i:
                i -= 1
                token = word[i:j]
                if token in tokens:
                    known = near[i].get(token)
                    if known is None:
                        known = self.beside(last[i], token)
                    if known:
                        count, own = counts[i] + 1, token
                        break
            counts.append(count)
            last.append(own)
            near.append(apart[own])
        self.before = word
        return counts[:]

    def points(self, word: str, spelled: str | None = None) -> list[int]:
        """Counts of the prefixes of one pre-token by code points, from one code point on."""
        counts = self.letters(spelled or self.source.as_letters(word))
        if word.isascii():
            return counts[1:]
        return [counts[e] for e in accumulate(len(c.encode("utf-8", "replace")) for c in word)]

    def plain(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special strings."""
        out: list[int] = []
        base, at, run_to = 0, 0, 0
        for word in self.source.pretokens(text):
            own = self.points(word)
            spaces = next((i for i, c in enumerate(word) if not _white(c)), len(word))
            if spaces and at >= run_to:  # a run of white space is one pre-token for as long as nothing follows it
                run_to = at
                while run_to < len(text) and _white(text[run_to]):
                    run_to += 1
                run_base, run_at, run = base, at, self.points(text[at:run_to])
            for k, count in enumerate(own):
                if k < spaces:
                    out.append(run_base + run[at + k - run_at])
                elif k == 1 and word in CONTRACTIONS:  # a cut leaves the quote and a letter
                    out.append(base + 2)
                else:
                    out.append(base + count)
            base += own[-1]
            at += len(word)
        return out

    def counts(self, text: str) -> list[int]:
        """As ``plain``, with special strings as one token each once they are whole."""
        if END_TEXT not in text:
            return self.plain(text)
        out: list[int] = []
        base = 0
        parts = text.split(END_TEXT)
        for k, part in enumerate(parts):
            if k + 1 < len(parts):
                cut = self.plain(part + END_TEXT[:-1])
                out += [base + c for c in cut]
                base += (cut[len(part) - 1] if part else 0) + 1
                out.append(base)
            else:
                out += [base + c for c in self.plain(part)]
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """Deltas of pre-tokens. They are counted in order, so neighbours share their beginnings."""
        spelled = list(map(self.source.as_letters, words))
        out = [b""] * len(words)
        for k in sorted(range(len(words)), key=spelled.__getitem__):
            own = self.points(words[k], spelled[k])
            if words[k] in CONTRACTIONS:
                own[1] = 2
            out[k] = array("h", map(sub, own, [0, *own])).tobytes()
        return out

    def known(self, words: set[str]) -> dict[str, bytes]:
        """Deltas of pre-tokens, from ``memory`` where it holds them."""
        keys = {w: w[1:] if w[0] == " " else " " + w for w in words}
        found = {w: self.memory[k] for w, k in keys.items() if k in self.memory}
        new = [w for w in words if w not in found]
        found.update(zip(new, self.of_words(new), strict=True))
        if len(self.memory) < self.most:
            self.memory.update((keys[w], found[w]) for w in new if 1 < len(w) <= 64)
        return found

    def additive(self, piece: str) -> bool:
        """Longer runs of white space are one pre-token for as long as nothing follows them."""
        return _RUN.search(piece) is None

    def of_others(self, pieces: list[str]) -> list[bytes]:
        cut = [self.source.pretokens(" " + p) if END_TEXT not in p and self.additive(p) else None for p in pieces]
        known = self.known({w for c in cut for w in c or ()})
        return [self.whole(" " + p) if c is None else b"".join([known[w] for w in c]) for p, c in zip(pieces, cut, strict=True)]

    def whole(self, text: str) -> bytes:
        if text and END_TEXT not in text and not text[-1].isspace() and self.additive(text):
            words = self.source.pretokens(text)
            known = self.known(set(words))
            return b"".join([known[w] for w in words])
        return array("h", map(sub, counts := self.counts(text), [0, *counts])).tobytes()

    def deltas(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


def _white(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f"


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(encoder(path))


def prefix_counts(table: bytes | None) -> np.ndarray:
    """A stored table as counts: entry k is the count of the first k code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table or b"", DELTA), dtype=np.int64)])


def fitting(table: bytes | None, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= limit)[-1])


def token_table(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int | None = None) -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, prefix_table) of every row; ``prefix_table`` holds the count of every prefix.

    With a ``limit`` the tables answer one budget question on their way out: ``fits_chars`` is ``longest_prefix`` of that limit.
    """

    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(path)
        for batch in larger(batches):
            texts = pc.fill_null(batch.column(1), "")
            deltas, bounds = by.batch(texts)
            counts = np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])
            tables = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * DELTA.itemsize).astype(np.int32)), pa.py_buffer(deltas)])
            columns = {
                id_column: batch.column(0),
                "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                "n_chars": pa.array(np.diff(bounds)),
                "n_tokens": pa.array(counts[bounds[1:]] - counts[bounds[:-1]]),
                "prefix_table": tables,
            }
            if limit is not None:
                columns["fits_chars"] = pa.array([int(np.flatnonzero(counts[a : b + 1] <= counts[a] + limit)[-1]) for a, b in zip(bounds, bounds[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_column].dataType.simpleString()
    columns = [F.col(id_column).alias("id"), F.col(text_column).alias("text")]
    return docs.select(*columns).mapInArrow(run, f"{id_column} {kind}, n_bytes long, n_chars long, n_tokens long, prefix_table binary" + ", fits_chars long" * (limit is not None))


def tokens_of_prefix(table: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` code points (a longer wish: the whole text), read from the table."""

    @F.pandas_udf("long")
    def ask(tables: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(t or b"", DELTA)[: int(n)].sum(dtype=np.int64)) for t, n in zip(tables, lengths, strict=True)], dtype="int64")

    return ask(table, n_chars)


def longest_prefix(table: Column, limit: int) -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens, read from the table."""

    @F.pandas_udf("long")
    def ask(tables: pd.Series) -> pd.Series:
        return pd.Series([fitting(t, limit) for t in tables], dtype="int64")

    return ask(table)


def op4_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Counts of every document; ``fits_chars`` is how much of the text a budget of ``limit`` tokens holds."""
    table = token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), limit=limit)
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")
