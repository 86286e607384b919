"""Tables written to the folder that a cluster shares, to cut lineage, and taken away once nothing reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most some tens of bytes up to which a counted table is sent to every executor; larger ones are joined by shuffles.
MOST_SENT = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks share the machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and reread; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            df._stored_at = None


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A stored table of narrow rows with the hint to broadcast it if it has at most ``most`` rows; else as it is."""
    return F.broadcast(df) if df.count() <= most else df
