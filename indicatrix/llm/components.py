"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours tied to the smallest of node and neighbours: those above the node, or those up to it and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    tied = both.join(low, "a")
    moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if larger_only else \
        tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return moved.where("a != b")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root (the smallest node of its component) of all nodes that have an edge; edges has columns a and b.

    Large stars and small stars in turn until the edges stay: a few rounds, however long the chains. A node with very many edges is reduced to a minimum
    before the shuffle and met by a join that adaptive execution splits. Each round is written to the shared folder; the table before it is dropped.
    """
    current = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, turn = state, turn + 1
        current = scratch.keep(_to_smallest(_to_smallest(current, True), False).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
