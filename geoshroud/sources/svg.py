"""SVG elements of a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tenths(c: Column) -> Column:
    """One decimal, rounded from the exact value with ties to even as C's printf does; ``format_string`` rounds ties up."""
    return F.call_function("format_number", c, F.lit("0.0"))


def svg_lines(ends: DataFrame, nodes: DataFrame, width: float = 800.0, height: float = 600.0, margin: float = 40.0) -> DataFrame:
    """``u, v, element``: one line element an edge; both axes are scaled into the page on their own, y is not flipped."""
    b = nodes.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    j = ends.join(F.broadcast(b))
    span = lambda lo, hi: F.when(F.col(hi) - F.col(lo) < 1e-12, F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))
    at = lambda c, lo, hi, size: _tenths(F.lit(margin) + (F.col(c) - F.col(lo)) / span(lo, hi) * (size - 2 * margin))
    return j.select("u", "v", F.concat(F.lit('<line x1="'), at("ux", "w", "e", width), F.lit('" y1="'), at("uy", "s", "n", height), F.lit('" x2="'), at("vx", "w", "e", width), F.lit('" y2="'), at("vy", "s", "n", height), F.lit('"/>')).alias("element"))


def page(nodes: DataFrame, edges: DataFrame, width: float = 800.0, height: float = 600.0, margin: float = 40.0) -> DataFrame:
    """``layer, id, element``: a whole page in order of ``layer``: 0 its head, 1 edges, 2 nodes, 3 its foot."""
    from ..operators.graph import with_ends

    spark = nodes.sparkSession
    lines = svg_lines(with_ends(edges, nodes), nodes, width, height, margin)
    lines = lines.select(F.lit(1).alias("layer"), F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")).alias("id"), F.replace("element", F.lit("/>"), F.lit(' stroke="#56B4E9" stroke-width="1.5" opacity="0.7"/>')).alias("element"))
    b = nodes.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    span = lambda lo, hi: F.when(F.col(hi) - F.col(lo) < 1e-12, F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))
    at = lambda c, lo, hi, size: _tenths(F.lit(margin) + (F.col(c) - F.col(lo)) / span(lo, hi) * (size - 2 * margin))
    dots = nodes.join(F.broadcast(b)).select(F.lit(2).alias("layer"), F.col("node_id").cast("string").alias("id"), F.concat(F.lit('<circle cx="'), at("x", "w", "e", width), F.lit('" cy="'), at("y", "s", "n", height), F.lit('" r="3" fill="#D55E00"/>')).alias("element"))
    ends = spark.createDataFrame([(0, "", f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">'), (3, "", "</svg>")], "layer int, id string, element string")
    return ends.unionByName(lines).unionByName(dots)
