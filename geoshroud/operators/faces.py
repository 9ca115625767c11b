"""Faces of crossing-free drawings from their geometric rotation system."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import with_ends
from .iterate import keep, orbits


def half_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, v, ux, uy, vx, vy, face``: every edge in both directions with the least half-edge code of its face."""
    e = with_ends(edges.filter("u <> v"), nodes)
    both = e.select("u", "v", "ux", "uy", "vx", "vy").union(e.select("v", "u", "vx", "vy", "ux", "uy"))
    w = Window.partitionBy("u").orderBy(F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")), "v")
    turn = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = keep(both.withColumn("h", F.col("u") * (1 << 31) + F.col("v")).withColumn("cw", F.coalesce(F.lag("v").over(w), F.last("v").over(turn))), "half-edges")
    # after (u, v) a face goes on from v to the neighbour clockwise before u
    succ = both.select((F.col("v") * (1 << 31) + F.col("u")).alias("h"), (F.col("u") * (1 << 31) + F.col("cw")).alias("n"))
    return both.join(orbits(succ), "h").select("h", "u", "v", "ux", "uy", "vx", "vy", F.col("orbit").alias("face"))


def face_areas(half: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``face, n_vertices, area`` (signed, counter-clockwise positive); the outer face of a component is the negative one."""
    cross = F.col("u" + x) * F.col("v" + y) - F.col("v" + x) * F.col("u" + y)
    return half.groupBy("face").agg(F.count("*").alias("n_vertices"), (F.sum(cross) * 0.5).alias("area"))


def face_adjacency(half: DataFrame, inner: DataFrame) -> DataFrame:
    """``f1 < f2``: interior faces that share an edge."""
    a = half.join(inner.select("face"), "face", "left_semi").select("u", "v", "face")
    b = a.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("face").alias("f2"))
    return a.join(b, ["u", "v"]).filter("face < f2").select(F.col("face").alias("f1"), "f2").distinct()


def area_residuals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of relative area errors over faces: n, median, max, 95th percentile (0 where there is no face)."""
    j = before.select("face", F.abs("area").alias("a")).join(after.select("face", F.abs("area").alias("b")), "face")
    rel = F.abs(F.col("b") - F.col("a")) / F.greatest("a", F.lit(1e-15))
    pick = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return j.select(rel.alias("r")).agg(
        F.count("*").alias("n_faces"), pick(F.percentile("r", 0.5)).alias("area_median_rel_error"), pick(F.max("r")).alias("area_max_rel_error"),
        pick(F.percentile("r", 0.95)).alias("area_p95_rel_error"), F.coalesce(F.percentile("r", 0.5) <= 0.05, F.lit(True)).alias("area_within_tol"),
    )
