"""Connected components of an edge table, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _joined_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """(v, m): rows (u, v) with the least neighbour m of their u; the centre of a large star doesn't gather its rows."""
    return attach(rows, least, "u", "_n", n_rows, ["v"], merge=True).select("v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) longs, each an undirected link -> (node, root), root the least node of its component.

    Alternating stars: every node's larger neighbours are linked to its least
    neighbour, then its smaller ones and itself are. Each round is a written
    table, and the driver only sees its count and checksum. Nodes without a link to
    another node aren't in the result; self links and repeats change nothing.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n"))
        # of each link, the smaller end's least neighbour: the larger end comes to it
        large = _joined_least(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = _joined_least(large, least, large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
