"""Operator 1, URL filters: listed rules first, then the ratio of two character language models.

All of it is DataFrame expressions. Accepted and rejected URLs each get a variable-order Markov model over
their characters: up to ``ORDER`` characters of context, each order backing off to the next shorter one with
Witten-Bell weights. The models are a table of distinct n-grams that grows with the URLs. Scoring sends every task
the frequent n-grams, whose number has a bound, and joins the others by a shuffle; no n-gram is so frequent there that it would make a task long.
A URL's score is its mean log-likelihood difference a character; the threshold is
the one that parts labelled URLs kept out of the fit best, counting both classes alike.

The classes are weak labels: rejected are URLs that a block rule fits or whose host holds one of
``reject_terms``; accepted are the others.

Null URLs and URLs without ``://`` have an empty host and path, no rule, no score
and the verdict allow. Without URLs of both classes the method allows all. A score equal to the threshold
is blocked. URLs of any length are read whole. Repeated rows are judged one by one, an empty table gives none.
Only the id and the URL are read of the input, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

#: Characters of context at most, and how many characters share the last of the probability (a fixed value: all of Unicode).
ORDER, ALPHABET = 5, 1_114_112
#: Of four folds by host, the one that the threshold is read from and the models aren't.
HELD_OUT = 0
#: (verdict, rule); the part before the first slash is the host, the rest the path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Rules stand as a chain of conditions; longer lists belong in a joined table.
MOST_RULES = 200
#: Host terms that label a URL as rejected.
REJECT_TERMS = ["ads-track", "adult", "bets", "casino", "pills", "poker", "porn", "spam"]
BIN = 0.005
#: N-grams that are more than one in so many of all, so fewer than that, are sent to every task; also all of them if they are no more.
MOST_COMMON = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def grams(text: Column) -> Column:
    """Every character of a text that is not empty, and an end, with the ``ORDER`` before it."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(padded) - ORDER))
    return F.transform(at, lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(gram, n, ratio): log P(rejected) - log P(accepted) of its last character after the others, for every n-gram, which stands ``n`` times; a stored table.

    ``labelled`` is (text, rejected); ``rejected`` is null for texts that are only to be scored.
    """
    each = labelled.select(F.explode(grams(F.col("text"))).alias("gram"), F.coalesce(F.col("rejected").cast("int"), F.lit(0)).alias("r"), F.coalesce((~F.col("rejected")).cast("int"), F.lit(0)).alias("a"))
    counts = written(each.groupBy("gram").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("a").alias("a")), "grams")
    lower = None
    for size in range(1, ORDER + 2):
        level = counts.groupBy(F.substring("gram", -size, size).alias("gram")).agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("a").alias("a"))
        context = Window.partitionBy(F.substring("gram", 1, size - 1))  # as many rows as there are characters
        level = level.select("gram", "n", *[c.alias(f"{k}_{n}") for k in "ra" for n, c in (("count", F.col(k)), ("all", F.sum(k).over(context)), ("kinds", F.count_if(F.col(k) > 0).over(context)))])
        if lower is not None:
            level = level.join(lower, F.substring("gram", 2, size - 1) == F.col("suffix"))
        mixed = {}
        for k in "ra":
            below = F.lit(1.0 / ALPHABET) if lower is None else F.col(f"{k}_below")
            count, total, kinds = (F.col(f"{k}_{n}") for n in ("count", "all", "kinds"))
            mixed[k] = F.when(total > 0, (count + kinds * below) / (total + kinds)).otherwise(below)
        if size <= ORDER:
            lower = level.select(F.col("gram").alias("suffix"), *[mixed[k].alias(f"{k}_below") for k in "ra"])
    out = written(level.select("gram", "n", (F.log(mixed["r"]) - F.log(mixed["a"])).alias("ratio")), "ratios")
    discard(counts)
    return out


def mean_ratios(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(row, score) of every text (row, text) that is not empty: the mean of its n-grams' ratios. ``ratios`` has all their n-grams."""
    each = texts.select("row", F.explode(grams(F.col("text"))).alias("gram"))
    kinds, total = ratios.agg(F.count("*"), F.sum("n")).first()
    if kinds <= MOST_COMMON:
        found = each.join(F.broadcast(ratios), "gram").select("row", "ratio")
    else:
        common = F.col("n") * MOST_COMMON > total
        sent = F.broadcast(ratios.where(common))
        others = each.join(sent, "gram", "left_anti").join(ratios.where(~common), "gram")
        found = each.join(sent, "gram").select("row", "ratio").unionByName(others.select("row", "ratio"))
    return found.groupBy("row").agg(F.avg("ratio").alias("score"))


def best_cut(scored: DataFrame) -> float:
    """The score above which labelled URLs (score, rejected) are best called rejected, both classes weighing alike; halfway down to the next lower score."""
    bins = scored.where("score IS NOT NULL").groupBy(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / BIN).alias("bin"))
    bins = bins.agg(F.sum(F.col("rejected").cast("long")).alias("r"), F.sum((~F.col("rejected")).cast("long")).alias("a"))
    down, whole = Window.orderBy(F.desc("bin")), Window.partitionBy()
    share = F.sum("r").over(down) / F.sum("r").over(whole) - F.sum("a").over(down) / F.sum("a").over(whole)
    middle = (F.col("bin") + F.coalesce(F.lead("bin").over(down) + 1, F.col("bin"))) / 2
    best = bins.select("bin", middle.alias("middle"), share.alias("gain")).orderBy(F.desc("gain"), F.desc("bin")).first()  # at most 8,001 bins
    return best["middle"] * BIN if best and best["gain"] is not None else float("inf")


def filtered_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, reject_terms=REJECT_TERMS) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    host, path = host_and_path(F.col(url_column))
    base = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    listed = F.lit(False)
    for term in reject_terms:
        listed = listed | F.col("host").contains(term)
    base = base.select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), ascii_lower(F.concat("host", "path")).alias("text"), listed.alias("listed"))
    base = written(base.withColumn("rejected", F.col("listed") | F.coalesce(F.col("ruled") == "block", F.lit(False))), "urls")
    if base.where("text <> ''").select("rejected").distinct().count() < 2:
        return base.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == HELD_OUT
    both = base.where((F.col("text") != "") & held).select("rejected").distinct().count() == 2 and base.where((F.col("text") != "") & ~held).select("rejected").distinct().count() == 2
    fitted = F.when(~held | F.lit(not both), F.col("rejected"))  # with too few hosts to hold any out, the threshold is read from the fitted ones
    ratios = log_ratios(base.select("text", fitted.alias("rejected")))
    scored = base.join(written(mean_ratios(base, ratios), "scores"), "row", "left")
    cut = best_cut(scored.where(held | F.lit(not both)).select("score", "rejected"))
    method = F.when(F.coalesce(F.col("score") >= cut, F.lit(False)), "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
