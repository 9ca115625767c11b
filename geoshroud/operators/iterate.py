"""Loops over DataFrames: each round is written to the shared checkpoint folder, which cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written as Parquet where every executor can read it, and reread."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="geoshroud-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component`` with the least node id of each connected component.

    Labels hook onto their least neighbour label, pointer jumping flattens the forest, edges are rewritten to labels;
    O(log n) rounds of joins and partial aggregates.
    """
    labels = nodes.select("node_id", F.col("node_id").alias("component"))
    e = keep(edges.filter("u <> v").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct(), "edges")
    while not e.isEmpty():
        both = e.union(e.select("y", "x"))
        tree = keep(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("r")), "tree")
        while True:
            up = tree.select(F.col("x").alias("r"), F.col("r").alias("rr"))
            j = keep(tree.join(up, "r").select("x", "r", "rr"), "jump")
            tree = j.select("x", F.col("rr").alias("r"))
            if j.filter("r <> rr").isEmpty():
                break
        labels = keep(labels.join(tree.select(F.col("x").alias("component"), "r"), "component", "left").select("node_id", F.coalesce("r", "component").alias("component")), "labels")
        e = e.join(tree.select("x", F.col("r").alias("rx")), "x").join(tree.select(F.col("x").alias("y"), F.col("r").alias("ry")), "y")
        e = keep(e.filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
    return labels


def orbits(succ: DataFrame, done: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """``h, orbit`` for a permutation ``h -> n``: the least member of each cycle, by pointer doubling."""
    at = keep(succ.select("h", "n", F.least("h", "n").alias("m")), "orbit")
    while True:
        ahead = at.select(F.col("h").alias("n"), F.col("n").alias("n2"), F.col("m").alias("m2"))
        new = keep(at.join(ahead, "n").select("h", F.col("n2").alias("n"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("moved")), "orbit")
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            return at.select("h", F.col("m").alias("orbit"))
