"""Elevation grids and habitat masks as pixel tables (row, col, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import components

NEAR = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def idw(spark: SparkSession, peaks: DataFrame, rows: int, cols: int, x0: float = 0.0, y0: float = 0.0, step: float = 1.0, most: int = 100_000) -> DataFrame:
    """``row, col, z``: inverse-distance (power 2) elevation of peaks ``x, y, ele``; missing or low ``ele`` count as 300.

    Peaks are control points of one map sheet: their number is checked before every pixel meets all of them.
    """
    n = peaks.count()
    if n > most:
        raise ValueError(f"{n} peaks; give at most {most} for a sheet")
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    if not n:  # a radial hill
        r = F.sqrt(F.pow(F.col("row") / (rows / 2.0) - 1, 2) + F.pow(F.col("col") / (cols / 2.0) - 1, 2))
        return grid.select("row", "col", F.greatest(F.lit(0.0), 530 * (1 - F.pow(r, 1.5))).alias("z"))
    ele = F.expr("try_cast(ele AS DOUBLE)")
    p = peaks.select("x", "y", F.when(ele > 0, ele).otherwise(F.lit(300.0)).alias("z"))
    g = grid.withColumn("gx", F.lit(x0) + F.col("col") * step).withColumn("gy", F.lit(y0) + F.col("row") * step)
    w = F.lit(1.0) / ((F.col("gx") - F.col("x")) * (F.col("gx") - F.col("x")) + (F.col("gy") - F.col("y")) * (F.col("gy") - F.col("y")) + 1e-9)
    return g.join(F.broadcast(p)).groupBy("row", "col").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))


def quantile_mask(dem: DataFrame, lo: float, hi: float = 1.0) -> DataFrame:
    """Pixels between two exact quantiles of z."""
    q = dem.agg(F.percentile("z", lo).alias("a"), F.percentile("z", hi).alias("b"))
    return dem.join(F.broadcast(q)).filter((F.col("z") >= F.col("a")) & (F.col("z") <= F.col("b"))).select("row", "col", "z")


def erode(mask: DataFrame, rounds: int = 1) -> DataFrame:
    """Pixels whose whole diamond of the given radius is in the mask: one aggregate, whatever the radius."""
    spots = [(i, j) for i in range(-rounds, rounds + 1) for j in range(-rounds, rounds + 1) if abs(i) + abs(j) <= rounds]
    at = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in spots])).alias("p")
    return mask.select(at).groupBy("p.row", "p.col").agg(F.count("*").alias("n")).filter(F.col("n") == len(spots)).select("row", "col")


def regions(mask: DataFrame) -> DataFrame:
    """``row, col, region``: 4-connected regions, named by their least pixel code."""
    code = lambda r, c: F.col(r) * (1 << 31) + F.col(c)
    m = mask.select("row", "col").distinct().withColumn("node_id", code("row", "col"))
    right = m.join(m.select("row", (F.col("col") - 1).alias("col"), F.col("node_id").alias("v")), ["row", "col"]).select(F.col("node_id").alias("u"), "v")
    down = m.join(m.select((F.col("row") - 1).alias("row"), "col", F.col("node_id").alias("v")), ["row", "col"]).select(F.col("node_id").alias("u"), "v")
    c = components(m.select("node_id"), right.union(down))
    return m.join(c, "node_id").select("row", "col", F.col("component").alias("region"))


def habitats(dem: DataFrame) -> DataFrame:
    """``row, col, species``: disjoint masks by priority (mountain, coast, valley)."""
    q = dem.agg(*[F.percentile("z", p).alias(n) for p, n in ((0.88, "high"), (0.2, "low"), (0.6, "mid"))])
    d = dem.join(F.broadcast(q))
    s = F.when(F.col("z") >= F.col("high"), "mountain").when(F.col("z") <= F.col("low"), "coast").when(F.col("z") <= F.col("mid"), "valley")
    return d.select("row", "col", s.alias("species")).filter("species is not null")
