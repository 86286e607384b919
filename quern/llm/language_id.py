"""Operator 8, language identification: known words by their frequency, unseen ones by shorter and shorter character n-grams.

``train`` counts words and character n-grams of labelled texts with Spark. Each language keeps its own frequencies of its
most frequent keys; any other frequency of a known key is the pooled one of all languages, and a kept one leans toward it by the same weight, so that what a language
with little text has never shown is no likelier in it than elsewhere. The model holds only what differs from the pooled
frequencies, in rows of (language, log ratio): at most ``MOST_WORDS + MOST_GRAMS`` of them a language and ``MOST_KEYS`` in all, whatever the number of languages.
``identify`` scores every word of every whole text. A word of the model adds its log frequency in each
language; any other word is read n-gram by n-gram, each place taking the longest
n-gram that the model knows. (A penalty for a step down, or a pooled frequency, is the same for all languages and so cancels.) The language with the largest
sum wins, by name among equals; the score is its share after a softmax in which long
texts count as ``CAP`` words.

Very long texts are counted word by word and summed in bounded parts; equal sums go to the first language by name.
Texts that are null or have no letter get ``und`` and score 0, as does everything if
there is no labelled text, as in an empty table. Null ids are never learned from. Of more than ``MOST_LANGUAGES`` different labels the ones with the fewest texts
are not learned. Rows are judged one by one, so repeated ones are alike; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import discard, map_arrow, small_batches, written

#: Bounds of the model and of the labelled sample that it is fitted on (documents, words and n-grams a language).
MOST_DOCS, MOST_WORDS, MOST_GRAMS = 2000, 40_000, 30_000
#: Languages that a model can tell apart: those with the most texts. Frequencies of their own that all of them keep together.
MOST_LANGUAGES, MOST_KEYS = 500, 1_000_000
LONGEST, CAP = 4, 20
#: Occurrences at pooled frequencies that every language starts with.
LEAN = 100.0
#: Rows that are summed at once.
GATHER = 100_000
WORDS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def sample_of(labelled: DataFrame) -> DataFrame:
    """About ``MOST_DOCS`` rows of (id, text, lang) in each language, by a hash of the id: the same ones on any cluster.

    The languages' sizes come to the driver and go back as one literal, so no text is shuffled; rows of labels beyond ``MOST_LANGUAGES`` stay out.
    """
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return labelled.select("lang", "text")
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], MOST_DOCS / r["n"])])
    return labelled.where(share < F.element_at(most, F.col("lang"))).select("lang", "text")


@dataclass
class Model:
    """What workers are sent: the known keys as one text, and for each its rows of (language, log ratio to the pooled frequency).

    ``sizes`` is 0 for a word, else the n-gram's length; ``shares`` holds, by that, each language's log weight of the pooled frequency.
    """

    languages: list[str]
    keys: str
    sizes: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    ratio: np.ndarray
    shares: np.ndarray


def train(labelled: DataFrame) -> Model | None:
    """A model of ``labelled`` (id, text, lang); None without any word."""
    words = F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ")).alias("key")
    counts = sample_of(labelled).select("lang", words).where("key <> ''").groupBy("lang", "key").agg(F.count("*").alias("n"))
    counts = written(counts, "word-counts")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    if not languages:
        return None
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))

    def at_each_place(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1)))
        return F.filter(F.transform(places, lambda i: F.substr(padded, i, F.lit(size))), lambda g: F.length(g) == size)

    grams = counts.select("lang", "n", F.explode(F.concat(*[at_each_place(size) for size in range(1, LONGEST + 1)])).alias("key"))
    grams = written(grams.groupBy("lang", "key").agg(F.sum("n").alias("n")), "gram-counts")
    by_size = {(r["k"], r["lang"]): r["n"] for r in grams.groupBy("lang", F.length("key").alias("k")).agg(F.sum("n").alias("n")).collect()}
    totals = np.array([[sums[lang] for lang in languages]] + [[by_size.get((k, lang), 0) for lang in languages] for k in range(1, LONGEST + 1)], float)
    each = MOST_KEYS // len(languages)

    def most(df: DataFrame, bound: int) -> pd.DataFrame:
        """(key, lang, n, pooled) of each language's ``bound`` most frequent keys; keys seen once in all are left out."""
        pooled = df.groupBy("key").agg(F.sum("n").alias("pooled"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
        chosen = df.withColumn("rank", rank).where(F.col("rank") <= bound)
        return chosen.join(pooled, "key").where("pooled > 1").select("key", "lang", "n", "pooled").toPandas()

    found = [most(counts, min(MOST_WORDS, each * MOST_WORDS // (MOST_WORDS + MOST_GRAMS))), most(grams, min(MOST_GRAMS, each * MOST_GRAMS // (MOST_WORDS + MOST_GRAMS)))]
    discard(counts, grams)
    found[1]["size"] = found[1]["key"].str.len()
    rows = pd.concat([found[0].assign(size=0), found[1]], ignore_index=True)
    rows["lang"] = rows["lang"].map({lang: k for k, lang in enumerate(languages)})
    rows = rows.sort_values(["size", "key", "lang"], ignore_index=True)
    size, n, pooled = rows["size"].to_numpy(int), rows["n"].to_numpy(float), rows["pooled"].to_numpy(float)
    leaning = LEAN * pooled / np.maximum(totals.sum(axis=1), 1)[size]
    first = (rows[["size", "key"]] != rows[["size", "key"]].shift()).any(axis=1).to_numpy()
    starts = np.append(np.flatnonzero(first), len(rows)).astype(np.int32)
    # keys are letters and marks of n-grams, never a line's end
    return Model(languages, "\n".join(rows["key"][first]), size[first].astype(np.int8), starts, rows["lang"].to_numpy(np.int16), np.log1p(n / leaning).astype(np.float32), np.log(LEAN / (totals + LEAN)))


class Scorer:
    """Scores of texts by a model."""

    def __init__(self, model: Model | None):
        self.model = model
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        for at, key in enumerate(model.keys.split("\n") if model and model.keys else ()):
            (self.grams if model.sizes[at] else self.words)[key] = at

    def unseen(self, word: str) -> list[int]:
        """For each place of ``^word$`` the longest known n-gram that starts there, if there is any."""
        text, grams = f"^{word}$", self.grams
        found = []
        for i in range(len(text) - 1):
            part = text[i : i + LONGEST]
            while part and part not in grams:
                part = part[:-1]
            if part:
                found.append(grams[part])
        return found

    def summed(self, places: list[int], weights: list[float]) -> np.ndarray:
        """The languages' weighted sums over keys of the model."""
        model, at, w = self.model, np.array(places, np.int64), np.array(weights)
        by_size = np.bincount(model.sizes[at], weights=w, minlength=LONGEST + 1)
        first, n = model.starts[at], model.starts[at + 1] - model.starts[at]
        row = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return by_size @ model.shares + np.bincount(model.language[row], weights=np.repeat(w, n) * model.ratio[row], minlength=len(model.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORDS.findall((text or "").lower())
        if not self.model or not words or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        places: list[int] = []
        weights: list[float] = []
        for word, n in Counter(words).items():
            at = self.words.get(word)
            if at is not None:
                places.append(at)
                weights.append(n)
            else:  # the mean over its places, scaled to a rare word's weight
                found = self.unseen(word)
                places += found
                weights += [n / max(1, len(word) + 3 - LONGEST)] * len(found)
            if len(places) > GATHER:
                total += self.summed(places, weights)
                places, weights = [], []
        if places:
            total += self.summed(places, weights)
        total *= min(1.0, CAP / len(words))
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_KEYS
    held: list[Scorer] = []

    def run(rows: dict[str, list]) -> dict[str, list]:
        if not held:
            held.append(Scorer(sent.value))
        found = [held[0].predict(t) for t in rows["text"]]
        return {id_column: rows["id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, f"{id_column} {kind}, lang_pred string, score double")


def fold(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 4


def learned(docs: DataFrame) -> Model | None:
    rows = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(rows.select(F.col("doc_id").alias("id"), "text", "lang"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a language and a score of ``least`` or more, with their own columns; the text is judged in place, nothing is joined."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs))
    held: list[Scorer] = []

    @F.pandas_udf("boolean")
    def good(texts):
        if not held:
            held.append(Scorer(sent.value))
        return pd.Series([found[0] != UNDETERMINED and found[1] >= least for found in map(held[0].predict, texts)], dtype=bool)

    return docs.where(good(F.col("text")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, learned(docs))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
