"""Outlines in the frequency domain: discrete Fourier transform, phase perturbation, inverse, area match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_phase


def descriptors(rings: DataFrame) -> DataFrame:
    """Rows ``poly_id, pos, x, y`` to ``poly_id, k, re, im`` (unnormalised).

    A ring of M points makes M*M terms inside its own group (M is a vertex count of one outline, not of the table).
    """
    n = rings.groupBy("poly_id").agg(F.count("*").alias("m"))
    t = rings.join(n, "poly_id").select("poly_id", "m", "pos", "x", "y", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("k"))
    a = F.lit(-2.0) * F.pi() * F.pmod(F.col("k") * F.col("pos"), F.col("m")) / F.col("m")
    return t.groupBy("poly_id", "k").agg(F.sum(F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).alias("re"), F.sum(F.col("x") * F.sin(a) + F.col("y") * F.cos(a)).alias("im"))


def perturb(spectrum: DataFrame, key: bytes, preserve: int = 3) -> DataFrame:
    """Components k >= preserve turned by keyed phases; the others are kept."""
    p = keyed_phase(key, F.col("poly_id"), F.col("k") - preserve)
    turn = spectrum.withColumn("p", F.when(F.col("k") >= preserve, p).otherwise(F.lit(0.0)))
    return turn.select("poly_id", "k", (F.col("re") * F.cos("p") - F.col("im") * F.sin("p")).alias("re"), (F.col("re") * F.sin("p") + F.col("im") * F.cos("p")).alias("im"))


def inverse(spectrum: DataFrame) -> DataFrame:
    """``poly_id, pos, x, y`` of a spectrum."""
    n = spectrum.groupBy("poly_id").agg(F.count("*").alias("m"))
    t = spectrum.join(n, "poly_id").select("poly_id", "m", "k", "re", "im", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("pos"))
    a = F.lit(2.0) * F.pi() * F.pmod(F.col("k") * F.col("pos"), F.col("m")) / F.col("m")
    s = t.groupBy("poly_id", "pos").agg(F.first("m").alias("m"), F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a)).alias("x"), F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a)).alias("y"))
    return s.select("poly_id", F.col("pos").cast("long").alias("pos"), (F.col("x") / F.col("m")).alias("x"), (F.col("y") / F.col("m")).alias("y"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """``poly_id, m, cx, cy, area``: vertex mean and unsigned shoelace area."""
    n = rings.groupBy("poly_id").agg(F.count("*").alias("m"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    a = rings.join(n, "poly_id").withColumn("np", F.pmod(F.col("pos") + 1, F.col("m")))
    b = rings.select("poly_id", F.col("pos").alias("np"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, ["poly_id", "np"]).groupBy("poly_id", "m", "cx", "cy").agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) * 0.5).alias("area"))


def match_area(rings: DataFrame, target: DataFrame) -> DataFrame:
    """Rings scaled about their vertex mean to the areas of ``target`` (poly_id, area); areas under 1e-15 stay."""
    j = rings.join(ring_areas(rings), "poly_id").join(target.select("poly_id", F.col("area").alias("want")), "poly_id")
    s = F.when(F.col("area") < 1e-15, F.lit(1.0)).otherwise(F.sqrt(F.abs(F.col("want") / F.col("area"))))
    return j.select("poly_id", "pos", (F.col("cx") + (F.col("x") - F.col("cx")) * s).alias("x"), (F.col("cy") + (F.col("y") - F.col("cy")) * s).alias("y"))
