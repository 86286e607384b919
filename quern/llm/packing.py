"""Operator 9, best-fit packing: documents are packed into sequences by vector best-fit.

Each text is encoded once and cut into pieces (only longer ones, full pieces behind
a shorter first one); the pieces' lengths and checksums go on, not their ids. Pieces are dealt by a hash
into groups of some ``GROUP`` pieces, and in each group, largest first, every piece goes to
the open sequence that suits it best among those with room under every limit: tokens, number of documents
and attention cost (the sum of squared piece lengths). ``norm`` takes the sequence whose
residual vector, less the piece, has the smallest weighted square norm; ``dot`` the largest
weighted product of residual and demand. A group wastes at most some sequence of its own, so
the number of groups, not their size, follows the data.

Null texts are empty documents of one end id. Repeated rows and null ids are packed each, and dealt apart. Texts of any length are cut, so no group grows with them. An
empty table gives no pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, written
from .tokens import encoder, tokenizer_path

GROUP = 8192


def pieces(docs: DataFrame, path: str, end_id: int, tokens: int, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every piece."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        by = encoder(path)
        end = np.array([end_id], by.dtype).tobytes()
        out: list[tuple] = []
        for name, own in zip(rows["id"], by.ids_of(rows["text"]), strict=True):
            ids = np.frombuffer(own + end, by.dtype).astype("<u4")
            first = len(ids) % tokens or tokens
            cuts = [0, *range(first, len(ids) + 1, tokens)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = ids[a:b].tobytes()
                out.append((name, k, a, b - a, zlib.crc32(part), part) if with_ids else (name, k, a, b - a, zlib.crc32(part)))
        columns = list(zip(*out, strict=True)) or [[]] * (5 + with_ids)
        return dict(zip((id_column, "piece", "start", "length", "ids_crc32", "ids"), map(list, columns)))

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, schema)


def best_fit(lengths: np.ndarray, tokens: int, most_docs: int, most_cost: float, weights=(1.0, 0.02, 0.02), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece, taken in decreasing length."""
    order = np.argsort(-lengths, kind="stable")
    limits = np.array([tokens, most_docs, most_cost], float)
    w = np.array(weights, float)
    n = len(lengths)
    room = np.zeros((3, n))  # of the open sequences: what is left of each limit, as shares of it
    name = np.zeros(n, np.int64)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used = np.zeros(n, np.int64)
    is_open = made = 0
    for item in order:
        length = int(lengths[item])
        demand = np.array([length, 1, float(length) ** 2]) / limits
        best = -1
        if is_open:
            left = room[:, :is_open] - demand[:, None]
            fits = (left >= -1e-12).all(axis=0)
            if fits.any():
                value = -(w @ (left * left)) if rule == "norm" else (w * demand) @ room[:, :is_open]
                best = int(np.where(fits, value, -np.inf).argmax())
        if best < 0:
            if (demand > 1 + 1e-12).any():
                raise ValueError("a piece exceeds a limit")
            best, is_open = is_open, is_open + 1
            room[:, best], name[best] = 1.0, made
            made += 1
        k = name[best]
        sequence[item], offset[item] = k, used[k]
        used[k] += length
        room[:, best] -= demand
        if room[:, best].min() < 0.5 / tokens:  # full: the last open one takes its place
            is_open -= 1
            room[:, best], name[best] = room[:, is_open], name[is_open]
    return sequence, offset


def packed(parts: DataFrame, tokens: int = 2048, most_docs: int | None = None, most_cost: float | None = None, rule: str = "norm", id_column: str = "doc_id") -> DataFrame:
    """``parts`` (a written table of pieces) with sequence_id and offset. The default limits on documents and attention cost bind no sooner than tokens."""
    most_docs, most_cost = most_docs or tokens, most_cost or float(tokens) ** 2
    groups = max(1, math.ceil(parts.count() / GROUP))
    # The row number of the stored table parts repeated rows, so no group grows with their copies.
    keyed = parts.withColumn("__group", F.pmod(F.xxhash64(id_column, "piece", F.monotonically_increasing_id()), F.lit(groups)))
    columns = parts.columns
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", id_column, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(frame["length"].to_numpy(), tokens, most_docs, most_cost, rule=rule)
        return frame[columns].assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    return keyed.groupBy("__group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokens: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    return packed(written(pieces(docs, path or tokenizer_path(), end_id, tokens), "pieces"), tokens)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
