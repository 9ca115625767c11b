"""Connected components as a loop of joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def merge_labels(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (v, c) after joining the components of the linked vertices (a, b); c is the least label of a component.

    Every round each label hooks onto its least linked label (a forest, since labels only fall), and pointer jumping
    flattens the forest; the links are then rewritten to labels.  Aggregates are partial, so a vertex with very many
    links costs one row for each task.
    """
    x = links.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    edges = scratch.keep(x.filter("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        tree = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("r"))
        tree = scratch.keep(tree, "tree")
        while True:
            up = tree.select(F.col("x").alias("r"), F.col("r").alias("rr"))
            jumped = scratch.keep(tree.join(up, "r", "left").select("x", "r", F.coalesce("rr", "r").alias("rr")), "jump")
            moved = not jumped.filter("r <> rr").isEmpty()
            tree = jumped.select("x", F.col("rr").alias("r"))
            if not moved:
                break
        labels = scratch.keep(labels.join(tree.select(F.col("x").alias("c"), "r"), "c", "left").select("v", F.coalesce("r", "c").alias("c")), "labels")
        e = edges.join(tree.select("x", F.col("r").alias("rx")), "x").join(tree.select(F.col("x").alias("y"), F.col("r").alias("ry")), "y")
        edges = scratch.keep(e.filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
    return labels
