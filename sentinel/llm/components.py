"""Connected components of a link table: alternating large-star and small-star rounds, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage

MAX_ROUNDS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; combined before the shuffle."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's lowest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_lowest(edges), "a").where("b > a").select(F.col("low").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself are linked to the lowest of them (a < b in ``edges``)."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    joined = edges.join(low, "b")
    return joined.select(F.col("low").alias("a"), F.col("a").alias("b")).union(low.select(F.col("low").alias("a"), "b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in a link; component is the smallest node reachable.

    A round makes two joins on the links; each star loses links, never connections. Rounds end when all
    links form stars around their lowest nodes, in about the logarithm of the longest chain.
    """
    def clean(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")),
                               F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = cut_lineage(clean(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    before = state(edges)
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(clean(_small_star(clean(_large_star(edges)))))
        now = state(edges)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = now
    raise RuntimeError("links did not settle")
