"""Canonical labels, order and hashes of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees
from .iterate import keep

ROUNDS = 5


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node_id, degree, label``: Weisfeiler-Lehman refinement of the degrees, eight hex digits of md5 a round.

    The neighbour list is hashed once per round from one shuffle by target node; a round is written out, so lineage
    does not grow.
    """
    d = degrees(nodes, edges)
    both = keep(edges.select("u", "v").union(edges.filter("u <> v").select("v", "u")).repartition("v"), "half-edges")
    at = keep(d.withColumn("label", F.col("degree").cast("string")), "wl")
    for _ in range(rounds):
        near = both.join(at.select(F.col("node_id").alias("v"), "label"), "v").groupBy(F.col("u").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("near"))
        new = at.join(near, "node_id", "left")
        at = keep(new.select("node_id", "degree", F.substring(F.md5(F.concat("label", F.lit("|"), F.coalesce("near", F.lit(""))).cast("binary")), 1, 8).alias("label")), "wl")
    return at


def canonical_order(labels: DataFrame) -> DataFrame:
    """``node_id, rank`` by (degree, label, id as text): ranks inside a degree and label prefix, placed by counts."""
    key = F.struct("degree", F.substring("label", 1, 2).alias("p"))
    l = labels.withColumn("k", key)
    base = l.groupBy("k").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("k")) - F.col("n")).select("k", "base")  # 256 rows a degree
    r = F.row_number().over(Window.partitionBy("k").orderBy("label", F.col("node_id").cast("string"))) - 1
    return l.withColumn("r", r).join(F.broadcast(base), "k").select("node_id", (F.col("r") + F.col("base")).cast("long").alias("rank"))


def wl_graph_hash(labels: DataFrame) -> DataFrame:
    """One row ``graph_hash``: SHA-256 of the sorted (label, count) histogram; equal for isomorphic graphs."""
    h = labels.groupBy("label").agg(F.count("*").alias("k"))
    return h.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("k").cast("string")))), ",").cast("binary"), 256).alias("graph_hash"))


def attribute_hash(elements: DataFrame, key: str, json: str, parts: int = 256) -> DataFrame:
    """One row ``attribute_hash``: a two-level hash of the elements' JSON texts in the order of their keys.

    SHA-256 over the parts' SHA-256, each over its sorted "key=json" hashes; no string grows with the table but one
    part's list of digests.
    """
    e = elements.select(F.sha2(F.concat_ws("=", F.col(key).cast("string"), json).cast("binary"), 256).alias("h"))
    p = e.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("d"))
    return p.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), "").cast("binary"), 256).alias("attribute_hash"))
