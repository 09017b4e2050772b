"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyrhythm.llm.common import with_extremes, written


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``: the smallest id that it reaches.

    Each round hangs all neighbours of an id on the smallest of them, first the larger neighbours,
    then the smaller ones; only minima are gathered, part by part, so an id with very many links is no
    large group.
    Rounds end when a round changes nothing; each is written, so none is computed twice.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_extremes(both, "a", "b", "b").where("b > a").select(F.col("b").alias("a"), F.least("a", "_low").alias("b"))
        large = large.where("a <> b").distinct()
        hung = with_extremes(large, "a", "b", "b").select(F.col("b").alias("a"), F.col("_low").alias("b")).where("a <> b")
        small = hung.unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))
