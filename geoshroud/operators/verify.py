"""How well an embedding keeps what it should keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_trip(a: DataFrame, b: DataFrame, atol: float = 1e-10, rtol: float = 1e-5) -> DataFrame:
    """One row: do the coordinates of all nodes agree; NaN, and a node that one side lacks, agree with nothing."""
    j = a.select("node_id", "x", "y").join(b.select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2")), "node_id", "full_outer")
    near = lambda p, q: F.coalesce((F.abs(F.col(p) - F.col(q)) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(q))) & ~F.isnan(p) & ~F.isnan(q), F.lit(False))
    return j.agg(F.count("*").alias("n_nodes"), F.coalesce(F.bool_and(near("x", "x2") & near("y", "y2")), F.lit(True)).alias("same"))


def length_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """``u, v, err``: signed relative length errors of the edges longer than 1e-12."""
    j = before.join(after.select("u", "v", F.col("length").alias("l2")), ["u", "v"]).filter(F.col("length") > 1e-12)
    return j.select("u", "v", ((F.col("l2") - F.col("length")) / F.col("length")).alias("err"))


def length_metrics(errors: DataFrame, rtol: float = 0.01) -> DataFrame:
    r = F.abs("err")
    return errors.agg(F.count("*").alias("n_edges"), F.round(F.avg(r), 6).alias("length_mean_rel_error"), F.round(F.max(r), 6).alias("length_max_rel_error"), F.coalesce(F.bool_and(r <= rtol), F.lit(True)).alias("length_within_tol"))


def error_histogram(errors: DataFrame, bins: int = 50) -> DataFrame:
    """``bin, n`` over equal bins between the least and the largest error; the largest is in the last bin."""
    ends = errors.agg(F.min("err").alias("lo"), F.max("err").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("err") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return errors.join(F.broadcast(ends)).select(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def topology(a_nodes: DataFrame, a_edges: DataFrame, b_nodes: DataFrame, b_edges: DataFrame) -> DataFrame:
    """One row of booleans: node count, edge count, degree sequence, label histogram and component count agree."""
    from .canon import wl_graph_hash, wl_labels
    from .graph import degree_sequence
    from .iterate import components

    def facts(n, e):
        d = degree_sequence(n, e).agg(F.array_sort(F.collect_list(F.struct("degree", "n_nodes"))).alias("deg"))
        c = components(n, e).agg(F.countDistinct("component").alias("comps"))
        return n.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges"))).join(d).join(wl_graph_hash(wl_labels(n, e))).join(c)  # one row each

    x, y = facts(a_nodes, a_edges).alias("x"), facts(b_nodes, b_edges).alias("y")
    names = [("node_count", "nodes"), ("edge_count", "edges"), ("degree_sequence", "deg"), ("wl_hash", "graph_hash"), ("components", "comps")]
    return x.join(y).select(*[(F.col(f"x.{c}") == F.col(f"y.{c}")).alias(n) for n, c in names])
