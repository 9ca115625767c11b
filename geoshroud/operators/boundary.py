"""Resampling of outlines by arc length, and rescaling into boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample(rings: DataFrame, n: int) -> DataFrame:
    """``poly_id, i, x, y``: n points at equal arc length along closed rings ``poly_id, pos, x, y``.

    Targets meet segments by a range condition inside the ring, so the join is an equi-join on poly_id.
    """
    w = Window.partitionBy("poly_id").orderBy("pos")
    turn = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = rings.select("poly_id", "pos", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(turn)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(turn)).alias("y2"))
    s = s.withColumn("d", F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y"))))
    s = s.withColumn("hi", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("d"))
    t = s.groupBy("poly_id").agg(F.max("hi").alias("total")).select("poly_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "total").withColumn("t", F.col("i") * F.col("total") / n)
    j = t.join(s, "poly_id").filter((F.col("lo") <= F.col("t")) & (F.col("t") < F.col("hi")))
    f = (F.col("t") - F.col("lo")) / F.col("d")
    one = j.groupBy("poly_id", "i").agg(F.min_by(F.struct((F.col("x") + f * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + f * (F.col("y2") - F.col("y"))).alias("y")), "pos").alias("p"))
    return one.select("poly_id", F.col("i").cast("long").alias("i"), "p.x", "p.y")


def rescale(nodes: DataFrame, like: DataFrame, floor: float = 1e-12) -> DataFrame:
    """``nodes`` moved and scaled isotropically, centre to centre, into the bounding box of ``like``."""
    box = lambda df, p: df.agg(F.min("x").alias(p + "w"), F.max("x").alias(p + "e"), F.min("y").alias(p + "s"), F.max("y").alias(p + "n"))
    b = nodes.join(F.broadcast(box(nodes, "a"))).join(F.broadcast(box(like, "b")))  # one row each
    k = F.least((F.col("be") - F.col("bw")) / F.greatest(F.col("ae") - F.col("aw"), F.lit(floor)), (F.col("bn") - F.col("bs")) / F.greatest(F.col("an") - F.col("as"), F.lit(floor)))
    go = lambda c, lo, hi: (F.col(c) - (F.col("a" + lo) + F.col("a" + hi)) / 2) * k + (F.col("b" + lo) + F.col("b" + hi)) / 2
    return b.select("node_id", go("x", "w", "e").alias("x"), go("y", "s", "n").alias("y"))
