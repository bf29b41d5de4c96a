"""Connected components of an edge table: alternating large-star and small-star steps, each written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _low(node: str, edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, with one more key than the aggregate: so a join deals both sides anew and Spark can split a hot node."""
    return edges.groupBy(node).agg(F.min("b").alias("m")).withColumn("k", F.xxhash64(node))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges(a, b) with a > b. Each step: minima by partial aggregation, then a join that AQE may split where a node is hot."""
    if small:
        low = _low("a", edges)
        out = edges.withColumn("k", F.xxhash64("a")).join(low, ["a", "k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _low("a", both).select(F.col("a").alias("u"), "k", F.least("a", "m").alias("m"))
        out = edges.select(F.col("b").alias("u"), F.xxhash64("b").alias("k"), F.col("a").alias("v")).join(low, ["u", "k"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (the smallest node it reaches), for nodes that have an edge."""
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        large = keep(_star(e, False), "large-star")
        small = keep(_star(large, True), "small-star")
        discard(e, large)
        e = small
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
