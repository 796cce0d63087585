"""Distributed connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, component)`` for each node of an edge; a component is named by its least node.

    Null ends and loops are ignored. Each half round is one aggregation to the least neighbour, which combines before
    the shuffle, and one join of two shuffled sides, which adaptive execution can split where a node has very many
    neighbours. Edges stay in written tables; only their count and a checksum come to the driver. No edge gives an
    empty table.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Large star: neighbours above u point to the least of u's neighbourhood. Small star: u and the neighbours below it do."""
        sym = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = scratch.table(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        joined = sym.join(least, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select("v", "m").union(least.select("u", "m")).toDF("u", "v")
        return scratch.table(out.where("u <> v").distinct())

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = scratch.table(edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    while True:
        then = star(star(now, True), False)
        after = state(then)
        scratch.drop(now)
        now = then
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
