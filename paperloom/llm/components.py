"""Connected components of an edge table, by contraction.

Each round every vertex points at its least neighbour (or itself), pointers are
followed once more, and the edges are rewritten to what they point at; loops
and repeats go. Every table of a round is written to the shared folder, so that
a lost executor costs one round and both sides of every join are plain scans:
a vertex with very many edges is then a skewed join that Spark splits.
Nothing but a row count reaches the driver. An edge to a pointer stays an edge
until its vertex points at a root, so the labels end at the least vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of edges; root is the least vertex of
    its component. Null ends and loops are no edges; empty edges give no row."""
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        near = left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")).unionByName(left.select(F.col("a").alias("v"), F.col("a").alias("p")).distinct())
        near = written(near.groupBy("v").agg(F.min("p").alias("p")), "near")
        step = near.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        points = written(near.join(step, "p").select("v", F.col("pp").alias("p")), "points")
        to_a = points.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to_b = points.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        half = written(left.join(to_a, "a").select("pa", "b"), "half")
        moved = half.join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        # a pointer that isn't a root yet stays tied to where it points
        chase = points.select(F.col("p").alias("v")).distinct().join(points, "v").where("p < v").select(F.col("p").alias("a"), F.col("v").alias("b"))
        before, left = left, written(moved.unionByName(chase).distinct(), "edges")
        forget(before, near, half)
        if labels is None:
            labels = points.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
        else:
            on = points.select(F.col("v").alias("root"), F.col("p").alias("next"))
            labels = labels.join(on, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
        before, labels = labels, written(labels, "labels")
        forget(before)
    if labels is None:
        return left.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return labels
