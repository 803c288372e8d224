"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.shared import materialise, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction over edges (u, v), u > v: neighbours are tied to each node's smallest one.

    The minimum is a hash aggregate with map-side combine and comes back by an equi-join,
    so a node with many neighbours is never gathered in one task.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    Self-loops give their node a component of its own; edges with a null end are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    work = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark = edges.sparkSession
    work, path = materialise(work, "cc")
    mark = None
    for _ in range(max_rounds):
        grown, longer = materialise(_star(_star(work, True), False), "cc")
        row = grown.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        remove(spark, path)
        work, path = grown, longer
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(work.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
