"""Operator 6, token-id output: canonical length-limited Huffman coding of token ids in blocks with checkpoints.

Files: a dataset of Parquet files whose rows are blocks, in ascending id order by (part, block), beside a
one-row codebook. A block holds whole documents: their ids and token counts, the
payload (a most-significant-bit-first bit stream) and checkpoints, the bit offset of every
``EVERY``-th token, so that a reader may start inside a block and decodes all its stretches at once,
each step looking ``limit`` bits up in one table. The code comes from the counts of ids in the whole table; its lengths
are the best ones under the limit (package-merge), and the lengths alone give the code back.

Null texts are empty documents: they hold the end id only. Null ids come first; repeated
ids stand in the order of a hash of their tokens. Ids are integers or strings. A text of any length is encoded whole and is
one document of one block, however long; an empty table gives a codebook without codes and no blocks. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import larger, map_arrow, shared_dir, small_batches, written
from .tokens import encoder, tokenizer_path

LIMIT, EVERY, BLOCK = 20, 64, 65_536


# -- the code --------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0: no code) of the best prefix code with no length above ``limit``, by package-merge."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    own = counts[symbols].astype(np.float64)
    levels: list[np.ndarray] = []  # of each level, whether its items, by weight, are symbols
    weights, leaf = own, np.ones(n, bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        pairs = len(weights) // 2
        packages = weights[0 : 2 * pairs : 2] + weights[1 : 2 * pairs : 2]
        both = np.concatenate([own, packages])
        order = np.argsort(both, kind="stable")
        weights, leaf = both[order], order < n
        levels.append(leaf)
    take = 2 * n - 2
    found = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        symbols_here = int(leaf[:take].sum())
        found[:symbols_here] += 1
        take = 2 * (take - symbols_here)
    lengths[symbols] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol, counting upward."""
    codes = np.zeros(len(lengths), np.uint64)
    order = _canonical_order(lengths)
    if len(order):
        top = int(lengths[order].max())
        steps = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        starts = np.concatenate([[np.uint64(0)], np.cumsum(steps, dtype=np.uint64)[:-1]])
        codes[order] = starts >> (top - lengths[order]).astype(np.uint64)
    return codes


def _canonical_order(lengths: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(lengths)
    return used[np.argsort(lengths[used], kind="stable")]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for every string of ``top`` bits, and ``top``, the longest length."""
    order = _canonical_order(lengths)
    top = int(lengths[order].max())
    repeat = 1 << (top - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << top, np.uint32)
    bits = np.full(1 << top, 1, np.uint8)
    total = int(repeat.sum())
    symbols[:total], bits[:total] = np.repeat(order, repeat), np.repeat(lengths[order], repeat)
    return symbols, bits, top


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of the ids."""
    size = lengths[ids].astype(np.int64)
    code = codes[ids]
    ends = np.cumsum(size)
    starts = ends - size
    word, stop = starts >> 6, (starts & 63) + size
    inside = np.where(stop <= 64, code << np.minimum(64 - stop, 63).clip(0).astype(np.uint64), code >> (stop - 64).clip(0).astype(np.uint64))
    words = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[heads]] = np.add.reduceat(inside, heads)
    over = np.flatnonzero(stop > 64)
    words[word[over] + 1] |= code[over] << (128 - stop[over]).astype(np.uint64)
    payload = words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8]
    return payload, starts[::EVERY].astype("<u8").tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block, all stretches between checkpoints at once."""
    symbols, bits, top = table
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.zeros((len(at), EVERY), np.uint32)
    tail = n - (len(at) - 1) * EVERY
    for k in range(EVERY):
        if k == tail:
            at = at[:-1]
        if not len(at):
            break
        found = ((window[at >> 3] << (at & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)) >> np.uint32(32 - top)
        out[: len(at), k] = symbols[found]
        at = at + bits[found]
    return out.reshape(-1)[:n]


# -- writing and reading ---------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) with the end id behind each document's ids, as little-endian bytes of the encoder's width."""

    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path)
        for batch in larger(batches):
            ids, bounds = by.batch(batch.column(1))
            ids = np.insert(ids, bounds[1:], by.dtype.type(end_id))
            cuts = (bounds + np.arange(len(bounds))) * by.dtype.itemsize
            held = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def id_counts(tokens: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """How often each id occurs: one row for each id and task is shuffled, at most ``vocabulary`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])

    rows = tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int, limit: int = LIMIT, id_column: str = "doc_id") -> None:
    """Writes the dataset ``target``/blocks and ``target``/codebook."""
    spark = docs.sparkSession
    ship_package(spark)
    by = encoder(path)
    dtype, vocabulary = by.dtype, max(by.library.get_vocab_size(), end_id + 1)
    tokens = written(encoded(docs, path, end_id, id_column), "token-ids")
    lengths = code_lengths(id_counts(tokens, dtype, vocabulary), limit)
    book = spark.createDataFrame([(bytearray(lengths.tobytes()), limit, EVERY)], "lengths binary, longest int, every int")
    book.coalesce(1).write.parquet(f"{target}/codebook")
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # 9 bytes for each id of the vocabulary
    kind = tokens.schema["id"].dataType.simpleString()
    schema = f"part int, block int, first long, n_tokens long, names array<{kind}>, sizes array<long>, checkpoints binary, payload binary"
    names_type = pa.list_(pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sizes_of, codes = sent.value
        names, sizes, held = [], [], []
        block = first = total = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype)
            payload, points = encode_block(ids, codes, sizes_of)
            row = [part, block, first, len(ids), list(names), list(sizes), points, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), names_type, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "first", "n_tokens", "names", "sizes", "checkpoints", "payload"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                sizes.append(len(ids) // dtype.itemsize)
                held.append(ids)
                total += sizes[-1]
                if total >= BLOCK:
                    yield close()
                    block, first, total = block + 1, first + total, 0
                    names, sizes, held = [], [], []
        if names:
            yield close()

    tie = F.xxhash64("ids")
    ordered = tokens.withColumn("tie", tie).repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    ordered.select("id", "ids").mapInArrow(run, schema).write.parquet(f"{target}/blocks")


def read_tokens(spark: SparkSession, target: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files alone."""
    ship_package(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{target}/codebook").first()["lengths"]), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{target}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each writing task
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kind = blocks.schema["names"].dataType.elementType.simpleString()
    held: list = []

    def run(rows: dict[str, list]) -> dict[str, list]:
        if not held and rows["n_tokens"]:
            held.append(decode_table(sent.value))
        out: list[tuple] = []
        for base, first, n, names, sizes, points, payload in zip(*rows.values(), strict=True):
            ids = decode_block(payload, points, n, held[0]).astype("<u4")
            at = 0
            for name, size in zip(names, sizes, strict=True):
                own = ids[at : at + size].tobytes()
                out.append((name, base + first + at, size, zlib.crc32(own), own) if with_ids else (name, base + first + at, size, zlib.crc32(own)))
                at += size
        columns = list(zip(*out, strict=True)) or [[]] * (4 + with_ids)
        return dict(zip((id_column, "start", "n_tokens", "ids_crc32", "ids"), map(list, columns)))

    placed = blocks.join(F.broadcast(offsets), "part")
    schema = f"{id_column} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(placed, ["base", "first", "n_tokens", "names", "sizes", "checkpoints", "payload"], run, schema)


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/quern-tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, tokenizer_path(), end_id=2)
    return read_tokens(spark, target)
