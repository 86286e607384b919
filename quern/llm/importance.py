"""Operator 13, target-distribution importance resampling with a dictionary of distinct features.

A document's features are its runs of one to ``most_words`` consecutive words. Tasks count
them document by document; the strings are then counted over all documents, each distinct string is
hashed once, and the buckets' sums against those of the target texts give each bucket a gain. The gains go back through the
dictionary: joined by string to the documents' own counts and summed to weights, to which Gumbel noise of a
hash of the id is added, so that taking the highest scores draws without replacement in proportion to exp(weight / 1000).

A string that makes up more than one part in ``FREQUENT`` of all features is sent to every task;
there can be no more than ``FREQUENT`` of these, and each is of ``SENT_BYTES`` at most. All other strings are joined by a
shuffle, in which no string then has more than that share of the rows, or is a longer one, which is hashed to
its digest first.

Null and empty texts have no features and weight 0. Rows are told apart by a number of their own, so repeated rows
and null ids each get a score (a null id's noise is that of an empty id) and compete for ranks, equal scores by smaller id, null ids last, then by that
number. A text of any length is counted whole in one task. Empty tables give no rows; an empty target or corpus counts 0 in every bucket. Other columns of
either table are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import running_sums
from .common import discard, map_arrow, written
from .licenses import _BYTES

#: Strings with a larger share of all features than one in this many are joined by broadcast.
FREQUENT = 100_000
#: Longest string that is sent or shuffled as it is, in bytes; longer ones take part as their SHA-256 in the join.
SENT_BYTES = 64


def word_runs(text: str | None, most_words: int = 1) -> tuple[int, Counter]:
    """(number of words, count of each run of 1 to ``most_words`` words) of a text; A-Z are lower-cased, other letters stay."""
    words = (text or "").encode("utf-8", "replace").translate(_BYTES).decode("utf-8").split(" ")
    words = [w for w in words if w]
    runs = (map(" ".join, zip(*(words[i:] for i in range(k)))) for k in range(2, most_words + 1))
    return len(words), Counter(chain(words, *runs))


def feature_counts(docs: DataFrame, text_column: str = "text", most_words: int = 1, id_column: str | None = None) -> DataFrame:
    """(id, n_words, n_features, features, counts) of every row; two arrays of equal length."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [word_runs(t, most_words) for t in rows["text"]]
        return {
            "id": rows["id"],
            "n_words": [n for n, _ in found],
            "n_features": [c.total() for _, c in found],
            "features": [list(c) for _, c in found],
            "counts": [list(c.values()) for _, c in found],
        }

    named = F.col(id_column) if id_column else F.lit(None).cast("long")
    kind = docs.schema[id_column].dataType.simpleString() if id_column else "long"
    return map_arrow(docs, [named.alias("id"), F.col(text_column).alias("text")], run, f"id {kind}, n_words long, n_features long, features array<string>, counts array<int>")


def dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """(feature, n, bucket) of every distinct string of ``feature_counts``; one checksum for each string."""
    each = counted.select(F.inline(F.arrays_zip("features", "counts"))).groupBy(F.col("features").alias("feature")).agg(F.sum("counts").alias("n"))
    return each.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gain(t, big_t, s, big_s, buckets: int) -> Column:
    """A bucket's log ratio of smoothed shares in target and corpus, in thousandths, rounded down."""
    t, s = F.col(t).cast("double"), F.col(s).cast("double")
    return F.floor(F.lit(1000.0) * F.ln((t + 1.0) * F.lit(float(big_s + buckets)) / ((s + 1.0) * F.lit(float(big_t + buckets))))).cast("long")


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def joined_by(feature: Column) -> Column:
    """The string itself, or the digest of a long one."""
    return F.when(F.octet_length(feature) > SENT_BYTES, F.concat(F.lit("\x00"), F.sha2(feature.cast("binary"), 256))).otherwise(feature)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, most_words: int = 1, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` counts the drawn ones from 1 on, others have null.

    ``percent`` of the rows of at least ``least_words`` words are drawn, rounded down.
    """
    counted = written(feature_counts(docs, text_column, most_words, id_column).withColumn("row", F.monotonically_increasing_id()), "features")
    known = written(dictionary(counted, buckets), "dictionary")
    wanted = dictionary(feature_counts(target, target_text, most_words), buckets)
    sums = lambda df, name: df.groupBy("bucket").agg(F.sum("n").alias(name))
    sizes = written(sums(known, "s").join(sums(wanted, "t"), "bucket", "full").na.fill(0, ["s", "t"]), "buckets")
    big_s, big_t = sizes.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    gains = sizes.select("bucket", gain("t", big_t, "s", big_s, buckets).alias("gain"))  # at most as many rows as buckets
    priced = known.join(F.broadcast(gains), "bucket").select(joined_by(F.col("feature")).alias("feature"), "gain", (F.col("n") * FREQUENT > big_s).alias("frequent"), "n")
    own = counted.select("row", F.inline(F.arrays_zip("features", "counts"))).select("row", joined_by(F.col("features")).alias("feature"), F.col("counts").cast("long").alias("n"))

    # the frequent ones' gains are added where the documents' counts are read; the others leave with their row
    frequent = priced.where("frequent").select("feature", "gain")
    met = own.join(F.broadcast(frequent), "feature", "left")
    near = met.where("gain IS NOT NULL").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("w"))
    rare = own.join(F.broadcast(frequent), "feature", "left_anti")
    far = rare.join(priced.where("NOT frequent").select("feature", "gain").hint("shuffle_hash"), "feature").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("w"))
    weights = near.unionByName(far).groupBy("row").agg(F.sum("w").alias("weight"))

    base = counted.select("row", F.col("id").alias(id_column), "n_words", "n_features")
    scored = base.join(weights, "row", "left").na.fill(0, ["weight"])
    scored = written(scored.withColumn("score", F.col("weight") + noise(id_column, seed)), "scores")
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    best = ranked(scored.where(F.col("n_words") >= least_words), id_column, drawn)
    out = written(scored.join(best, "row", "left").select(id_column, "n_features", "weight", "score", "rank"), "resampled")
    discard(counted, known, sizes, scored)
    return out


def ranked(scored: DataFrame, id_column: str, drawn: int) -> DataFrame:
    """(row, rank) of the first ``drawn`` rows by score, then id, then row; places are running counts of range partitions."""
    order = F.struct((-F.col("score")).alias("a"), F.col(id_column).isNull().alias("b"), F.col(id_column).alias("c"), F.col("row").alias("d"))
    placed = running_sums(scored.select("row", order.alias("order"), F.lit(1).alias("one")), "order", {"before": "one"})
    return placed.where(F.col("before") < drawn).select("row", (F.col("before") + 1).alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
