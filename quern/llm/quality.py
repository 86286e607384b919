"""Operator 3, quality rules: thresholds read from mergeable quantile sketches per language and source.

All of it is DataFrame expressions. One pass sketches cheap measures of every
document: a sketch holds how many documents fall in each bin of a logarithmic scale, so a quantile is
right within one percent of its value, sketches merge by adding their counts (upward to languages and to the
whole table), and the same rows give the same thresholds in any order. A threshold is the group's median plus
a multiple of its lower spread plus the noise that a text of the group's usual length has, within a bound,
so junk in the upper tail of a
group doesn't raise it, and a group in which a style is usual doesn't lose its
documents for it. Groups with few documents take their language's sketch, few
in the language: the table's. A second pass measures again, joins the thresholds
and filters.

Null texts have no words and fail the base rule. A null language or source is a
group of its own. A value equal to its threshold passes. Repeated rows are measured and returned one by one, empty tables
give empty results, and input columns named like a result (``m``, ``base_failed``, ``kept``) give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sent_if_small, written

SPACE = r"[\x20\x09-\x0D]+"
#: Measure: (multiple of the spread, what its share is of, most of the room above a median of zero, and its change with the median).
#: A document fails above median + least(multiple * (median - lower quartile) + noise, most + change * median). For shares the last stays
#: below the room up to 1, so every rule can fire however wide its group is spread.
RULES = {
    "symbols_per_word": (8.0, "n_words", 0.5, 1.0),
    "shout_share": (8.0, "word_chars", 0.4, -0.4),
    "dup_line_share": (8.0, "n_lines", 0.6, -0.6),
    "stutter_share": (8.0, "n_words", 0.3, -0.3),
    "mean_word": (10.0, "n_words", 3.0, 1.0),
}
#: Standard deviations, each of at most half a unit over the root of the count, that a share may be off by chance in a text of usual length.
NOISE = 4.0
#: Counts whose usual size in a group sets the noise.
COUNTS = ("n_words", "word_chars", "n_lines")
#: Ratio of neighbouring bins of a sketch: quantiles are right within half of what it is above 1.
BIN = 1.02
QUANTILES = (0.25, 0.5)
LEAST_GROUP = 50
NO_VALUE = "\u0000"


def _count_of(text: Column, char_class: str) -> Column:
    return (F.size(F.split(text, char_class)) - 1).cast("long")


def with_measures(docs: DataFrame, windows: bool, text_column: str = "text") -> DataFrame:
    """``docs`` with the column ``m``: a struct of the measures; the repeated windows only if asked for."""
    names = {"t": "__text", "w": "__words", "l": "__lines", "v": "__windows", "s": "__sorted"}
    t, w, lines, v, s = (names[k] for k in "twlvs")
    out = docs.withColumn(t, F.coalesce(F.col(text_column), F.lit("")))
    out = out.withColumn(w, F.filter(F.split(F.col(t), SPACE), lambda x: x != ""))
    out = out.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(w).cast("long")
    word_chars = F.aggregate(F.col(w), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    fields = {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": _count_of(F.col(t), r"[#*$%&|<>]"),
        "n_shout": _count_of(F.col(t), r"[A-Z!]"),
        "n_stutter": F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    if windows:
        out = out.withColumn(v, F.when(F.size(w) >= 9, F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8)))))
        repeats = F.size(F.array_distinct(v)) < F.size(v)
        out = out.withColumn(s, F.when(repeats, F.sort_array(F.transform(F.col(v), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        same = lambda x, k: F.coalesce(F.get(F.col(s), k)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(F.col(s), lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
        covered = F.aggregate(starts, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i + 8 - a["reach"])).cast("long").alias("n"), (i + 8).alias("reach")), lambda a: a["n"])
        fields["n_repeat_words"] = F.coalesce(covered, F.lit(0).cast("long"))
    out = out.withColumn("m", F.struct(*[c.alias(k) for k, c in fields.items()]))
    return out.drop(t, w, lines, v, s)


def ratios(m: str = "m") -> dict[str, Column]:
    words, lines = F.greatest(F.col(f"{m}.n_words"), F.lit(1)), F.greatest(F.col(f"{m}.n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col(f"{m}.n_symbols") / words,
        "shout_share": F.col(f"{m}.n_shout") / F.greatest(F.col(f"{m}.word_chars"), F.lit(1)),
        "dup_line_share": F.col(f"{m}.n_dup_lines") / lines,
        "stutter_share": F.col(f"{m}.n_stutter") / words,
        "mean_word": F.col(f"{m}.word_chars") / words,
    }


def _key(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NO_VALUE))


def bin_of(value: Column) -> Column:
    """The sketch's bin of a value; null for none above zero, which sorts first."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(BIN)).cast("int"))


def bin_value(of: Column) -> Column:
    return F.when(of.isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(BIN), of) / (BIN + 1))


def sketches(docs: DataFrame, lang: str, source: str, text_column: str) -> DataFrame:
    """(lang_key, source_key, k, bin, n): how many documents of each language and source have measure ``k`` in each bin; a stored table."""
    measured = with_measures(docs.select(_key(lang).alias("lang_key"), _key(source).alias("source_key"), F.col(text_column).alias("text")), windows=False)
    values = ratios() | {c: F.col(f"m.{c}").cast("double") for c in COUNTS}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), bin_of(c).alias("bin")) for k, c in values.items()]))
    return written(measured.select("lang_key", "source_key", each).groupBy("lang_key", "source_key", "k", "bin").agg(F.count("*").alias("n")), "sketches")


def limits_of(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys, {prefix}_n, a limit {prefix}_{rule} for each rule) from the counts of each bin; a group has some thousand bins at most."""
    merged = sketch.groupBy(*keys, "k", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "k")
    upto, whole = F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first())), F.sum("n").over(group)
    ranked = merged.select(*keys, "k", bin_value(F.col("bin")).alias("value"), upto.alias("upto"), whole.alias("whole"))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("whole"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(QUANTILES)}
    found = ranked.groupBy(*keys, "k").agg(F.max("whole").alias("n"), *at.values())
    one = {(k, i): F.max(F.when(F.col("k") == k, F.col(f"q{i}"))) for k in (*RULES, *COUNTS) for i in (0, 1)}
    wide = found.groupBy(*keys).agg(F.max("n").alias(f"{prefix}_n"), *[c.alias(f"{k}__{i}") for (k, i), c in one.items()])

    def limit(k: str) -> Column:
        by, count, most, change = RULES[k]
        low, mid, usual = F.col(f"{k}__0"), F.col(f"{k}__1"), F.greatest(F.col(f"{count}__1"), F.lit(1.0))
        noise = NOISE / 2 / F.sqrt(usual) * (mid if k == "mean_word" else F.lit(1.0))
        return mid + F.least(by * (mid - low) + noise, most + change * mid)

    return wide.select(*keys, f"{prefix}_n", *[limit(k).alias(f"{prefix}_{k}") for k in RULES])


def thresholds(docs: DataFrame, lang: str = "lang", source: str = "source", text_column: str = "text") -> DataFrame:
    """(lang_key, source_key, n, one threshold for each rule) of each language and source."""
    sketch = sketches(docs, lang, source, text_column)
    own = limits_of(sketch, ["lang_key", "source_key"], "g")
    tongue = limits_of(sketch, ["lang_key"], "l")
    top = limits_of(sketch, [], "a").where("a_n > 0").first() or {f"a_{k}": None for k in RULES}
    joined = own.join(tongue, "lang_key")
    chosen = [
        F.when(F.col("g_n") >= LEAST_GROUP, F.col(f"g_{k}")).when(F.col("l_n") >= LEAST_GROUP, F.col(f"l_{k}")).otherwise(F.lit(top[f"a_{k}"]).cast("double")).alias(f"max_{k}")
        for k in RULES
    ]
    return joined.select("lang_key", "source_key", F.col("g_n").alias("n"), *chosen)


def judged(docs: DataFrame, lang: str = "lang", source: str = "source", text_column: str = "text") -> DataFrame:
    """``docs`` with the struct ``m`` of measures and the booleans ``base_failed`` and ``kept``."""
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at = {name: f"__c{i}" for i, name in reversed(list(enumerate(docs.columns)))}
    limits = sent_if_small(written(thresholds(docs, lang, source, text_column), "limits").drop("n"))
    out = with_measures(inner, windows=True, text_column=at[text_column])
    out = out.withColumn("lang_key", _key(at[lang])).withColumn("source_key", _key(at[source])).join(limits, ["lang_key", "source_key"], "left")
    base = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    fine = F.lit(True)
    for k, c in ratios().items():
        fine = fine & (c <= F.coalesce(F.col(f"max_{k}"), F.lit(float("inf"))))
    out = out.withColumn("base_failed", base).withColumn("kept", ~base & fine)
    results = ["m", "base_failed", "kept"]
    return out.select(*[F.col(c).alias(name) for c, name in zip(inner.columns, docs.columns, strict=True) if name not in results], *results)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rule and their group's thresholds, with their own columns only."""
    renamed = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at = {name: f"__c{i}" for i, name in reversed(list(enumerate(docs.columns)))}
    # A row number keeps the optimizer from writing all measures out again in the filter, once for each use.
    numbered = judged(renamed, at["lang"], at["source"], at["text"]).select("*", F.monotonically_increasing_id().alias("__row"))
    kept = numbered.where(F.col("kept") & (F.col("__row") >= 0))
    return kept.select(*renamed.columns).toDF(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(docs).select("doc_id", *[F.col(f"m.{k}").alias(k) for k in measures], "base_failed", "kept")

