"""Reading tables, matrices and ratings into DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def import_data(spark: SparkSession, path: str, form: str | None = None, label: str | None = None, intercept: bool = True, order_key: str | None = None, valid_fraction: float = 0.0, **options) -> tuple[DataFrame, list[str], str]:
    """(rows, features, label): CSV, Parquet, ORC or JSON by the path's ending or ``form``; the last column is the label unless named.

    With a ``valid_fraction`` the last rows by ``order_key`` are marked ``is_valid``.
    """
    from ..functions.prepare import head_tail_split, with_intercept

    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**({"header": True, "inferSchema": True} | options if form == "csv" else options))
    df = reader.format(form).load(path)
    label = label or df.columns[-1]
    features = [c for c in df.columns if c not in (label, order_key)]
    if valid_fraction:
        if order_key is None:
            raise ValueError("a head and tail split needs an order_key")
        df = head_tail_split(df, order_key, valid_fraction)
    if intercept:
        df, features = with_intercept(df), [*features, "intercept"]
    return df, features, label


def rows_of_triples(matrix: DataFrame, columns: int) -> DataFrame:
    """(row, values) of (row, col, value) triples: an array of ``columns`` numbers for each row that has any, 0 where there is no triple.

    Values of one place are added; a row has at most ``columns`` of them when it meets, so no group is larger. Columns outside 0 to ``columns`` - 1 fail.
    """
    inside = F.assert_true((F.col("col") >= 0) & (F.col("col") < columns), F.lit("column out of range"))
    cells = matrix.where(inside.isNull()).groupBy("row", "col").agg(F.sum("value").cast("double").alias("value"))
    by_row = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "value"))).alias("cells"))
    return by_row.select("row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(0.0))).alias("values"))


def from_rows(spark: SparkSession, rows, prefix: str = "x") -> DataFrame:
    """Small in-memory data (lists, arrays, pandas) as a DataFrame of double columns; one dimension is one column."""
    import numpy as np
    import pandas as pd

    if isinstance(rows, pd.DataFrame):
        return spark.createDataFrame(rows)
    a = np.asarray(rows, float)
    a = a.reshape(-1, 1) if a.ndim == 1 else a
    return spark.createDataFrame(pd.DataFrame(a, columns=[f"{prefix}{i}" for i in range(a.shape[1])]))


def read_text_matrix(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Lines of numbers as one array column."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), separator).cast("array<double>").alias("features"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data lines of an ARFF file; names and numeric types come from its attribute lines (its head only goes to the driver)."""
    lines = spark.read.text(path)
    word = F.lower(F.trim("value"))
    heads = lines.where(word.startswith("@attribute")).select(F.trim("value").alias("v")).collect()
    fields = [h["v"].split(None, 2) for h in heads]
    parts = F.split(F.trim("value"), r"\s*,\s*")
    rows = lines.where(~word.startswith("@") & ~word.startswith("%") & (word != ""))
    number = lambda kind: kind.lower().split()[0] in ("numeric", "real", "integer")
    return rows.select(*[(F.try_element_at(parts, F.lit(i + 1)).try_cast("double") if number(f[2]) else F.try_element_at(parts, F.lit(i + 1))).alias(f[1].strip("'\"")) for i, f in enumerate(fields)])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(item, user, rating) of files in which a line ``item:`` heads the lines ``user,rating,...`` of that item.

    Files are read in blocks, and the last heading above a line is carried down within its block; what a block begins with
    takes the last heading of the file's blocks before it, from a table of one row for each block. Lines above a file's first heading have no item.
    """
    from ..plans.stored import stored

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = stored(lines.withColumn("head", F.when(F.col("value").endswith(":"), F.expr("try_cast(rtrim(':', value) AS long)"))), "ratings")
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line"))).alias("last"))
    carried = blocks.select("file", "block", F.last("last", ignorenulls=True).over(above).alias("carried"))
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split("value", ",")
    placed = lines.withColumn("own", F.last("head", ignorenulls=True).over(within)).where(~F.col("value").endswith(":")).join(F.broadcast(carried), ["file", "block"])
    return placed.select(F.coalesce("own", "carried").alias("item"), F.get(parts, F.lit(0)).try_cast("long").alias("user"), F.get(parts, F.lit(1)).try_cast("double").alias("rating"))


def read_sql(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(form).mode(mode).options(**options).save(path)


def triples(df: DataFrame, features: list[str], row: str) -> DataFrame:
    """Dense columns as (row, col, value) without zeros."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])
    return df.select(F.col(row).alias("row"), F.inline(cells)).where("value <> 0")


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of whole files, of those whose name fits ``pattern``; a file is one row."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


ARRAYS = "path string, member string, row long, values array<double>, error string"


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """(path, member, row, values, error) of the arrays in ``.npy`` and ``.npz`` files: a row for each index of the first dimension, the others laid flat.

    Files are decoded where they are read, one at a time. A member that can't be read, holds no numbers, or is pickled gives one row of nulls with the reason
    in ``error``, and so does a file that is no archive; a member without rows gives none, nor does a file of no bytes. Real numbers become doubles.
    """
    from ..session import ship_package

    ship_package(spark)
    return read_binary(spark, path, pattern).select("path", "content").mapInPandas(_decoded, ARRAYS)


def _decoded(batches):
    import io
    import zipfile

    import numpy as np
    import pandas as pd

    def rows(path: str, member: str, data: bytes):
        try:
            a = np.load(io.BytesIO(data), allow_pickle=False)
            if not (np.issubdtype(a.dtype, np.number) or a.dtype == bool) or np.iscomplexobj(a):
                raise ValueError(f"no real numbers but {a.dtype}")
            flat = a.reshape(len(a), int(np.prod(a.shape[1:]))) if a.ndim else a.reshape(1, 1)
        except Exception as e:  # whatever a damaged file brings about
            yield pd.DataFrame({"path": [path], "member": [member], "row": [None], "values": [None], "error": [f"{type(e).__name__}: {e}"]})
            return
        for at in range(0, len(flat), 4096):
            part = flat[at : at + 4096].astype(float)
            yield pd.DataFrame({"path": path, "member": member, "row": range(at, at + len(part)), "values": list(part), "error": None})

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            content = bytes(content)
            if not content.startswith(b"PK"):
                yield from rows(path, path.rsplit("/", 1)[-1].removesuffix(".npy"), content)
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = archive.namelist()
                    for name in names:
                        try:
                            data = archive.read(name)
                        except Exception:  # a damaged member gives its row below
                            data = b""
                        yield from rows(path, name.removesuffix(".npy"), data)
            except zipfile.BadZipFile as e:
                yield pd.DataFrame({"path": [path], "member": [None], "row": [None], "values": [None], "error": [f"BadZipFile: {e}"]})
