"""Helpers shared by the operators of this folder: tables written to the shared folder, Arrow mapping, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import discard, sent_if_small  # noqa: F401
from ..plans.stored import shared_folder as shared_dir  # noqa: F401
from ..plans.stored import stored as written  # noqa: F401
from ..session import ship_package

#: Words of the contracts for operators 3 and 5, and the letters they lower-case.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


#: Rows that go to a Python worker at once, and their bytes: texts are long, and two workers share an executor.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what holds whole texts; a lower setting of the user's stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)))  # other forms are a default, or no bound
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def larger(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: neighbours are put together until they hold ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_arrow(df: DataFrame, columns: list, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of the chosen ``columns`` as Python lists; it returns lists for ``schema``."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    chosen = df.select(*columns)
    empty = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return chosen.mapInArrow(run, schema)


def ascii_lower(column):
    """A-Z lower-cased and nothing else, whatever the locale."""
    return F.translate(column, UPPER, LOWER)
