"""Connected components of a graph given as rows, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import MOST_SENT
from .common import discard, sent_if_small, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): ``root`` is the smallest node reachable; a stored table.

    Each round first hangs every node's larger neighbours on its smallest neighbour,
    then its smaller neighbours; roots end up as stars after some log(n) rounds. The
    smallest neighbours are partial aggregates. Up to ``MOST_SENT`` edges they are sent to all edges; beyond it they
    are stored before they meet them, so that Spark may split a node with very many edges in the join.
    Raises an error if ``max_rounds`` aren't enough (each round about halves the longest path).
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    n = edges.count()
    kept = lambda df, tag: written(df, tag) if n > MOST_SENT else df  # noqa: E731  edges never become more
    sent = lambda df: sent_if_small(df) if n > MOST_SENT else F.broadcast(df)
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = kept(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
        hung = edges.join(sent(least), F.col("b") == F.col("n")).select("a", F.col("m").alias("b"))
        hung = kept(hung.where("a <> b").distinct(), "hung")
        down = kept(hung.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "down")
        lower = hung.join(sent(down), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(lower.union(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        discard(edges, least, hung, down)
        edges = new
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = written(roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
    discard(edges)
    return out
