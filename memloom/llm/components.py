"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import drop, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a long, b long) in any order, repeats and self links allowed; null ends are dropped.

    Returns (id, component) for every end of a link, where component is the smallest id
    reachable. Nothing is collected: each round is two aggregations and joins over the
    edges, written to the shared folder, and ends when a round changes nothing. The number
    of rounds grows with the logarithm of the longest path.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialize(edges, "edges")
    seen = _mark(edges)
    while seen[0]:
        before, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        drop(before)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(own)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum: three numbers, whatever the size."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each u's larger neighbours
    out = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # v < u throughout
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
