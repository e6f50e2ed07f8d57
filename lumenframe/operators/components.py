"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, materialise


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of edges (a long, b long): (node, comp), comp the least node of the component.

    Each round points every node at its least neighbour, follows the pointers once and replaces both ends of each
    edge by what they point to; edges inside a component vanish, so the graph shrinks until none is left. Every
    step is an aggregation with map-side combine or an equi-join, so a hub with very many edges is no single
    task's work, and each round is written to the shared scratch folder. Rows with a null end and loops are
    ignored; repeated rows don't matter; no edges give an empty result.
    """
    edges = materialise(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
        target = least.select(F.col("node").alias("t"), F.col("comp").alias("further"))
        step = materialise(least.join(target, F.col("comp") == F.col("t")).select("node", F.col("further").alias("comp")), "step")
        left = step.select(F.col("node").alias("a"), F.col("comp").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        rest = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(edges)
        edges = rest
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("t"), F.col("comp").alias("further"))
            joined = labels.join(to, F.col("comp") == F.col("t"), "left").select("node", F.coalesce("further", "comp").alias("comp"))
            old, labels = labels, materialise(joined, "labels")
            forget(old, step)
        if not edges.take(1):
            forget(edges)
            return labels
