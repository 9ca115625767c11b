"""Project layers of any geometry on a graph: parts of features, snapping, polygon measures, a registry by name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import layerfile
from . import overlay
from .iterate import keep
from .labelled import Labelled

_GEOMETRIES = "array<struct<type:string,coordinates:string,geometries:string>>"
_MULTI = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def parts(features: DataFrame) -> DataFrame:
    """Features (feature_id, type, coordinates and geometries as JSON text, attrs) to single geometries.

    ``part_id, feature_id, type (Point, LineString or Polygon), coordinates, attrs``; members of collections, at any depth, and of
    multi geometries are parts of their own; null and unknown geometries give none.
    """
    path = F.col("feature_id").cast("string")
    rows = features.select(path.alias("part_id"), "feature_id", "type", "coordinates", "geometries", "attrs")
    flat = rows.filter("type <> 'GeometryCollection'")
    while True:
        rows = rows.filter("type = 'GeometryCollection'").select("part_id", "feature_id", "attrs", F.posexplode(F.from_json("geometries", _GEOMETRIES)).alias("i", "g"))
        rows = rows.select(F.concat_ws(".", "part_id", F.col("i").cast("string")).alias("part_id"), "feature_id", "g.type", "g.coordinates", "g.geometries", "attrs")
        if rows.isEmpty():
            break
        rows = keep(rows, "members")
        flat = flat.unionByName(rows.filter("type <> 'GeometryCollection'"))
    one = flat.filter(F.col("type").isin("Point", "LineString", "Polygon")).select("part_id", "feature_id", "type", "coordinates", "attrs")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _MULTI.items() for x in kv]), F.col("type"))
    many = flat.filter(F.col("type").isin(*_MULTI)).select("part_id", "feature_id", kind.alias("type"), F.posexplode(F.from_json("coordinates", "array<string>")).alias("i", "coordinates"), "attrs")
    return one.unionByName(many.select(F.concat_ws(".", "part_id", F.col("i").cast("string")).alias("part_id"), "feature_id", "type", "coordinates", "attrs"))


def point_parts(p: DataFrame) -> DataFrame:
    c = F.from_json("coordinates", "array<double>")
    return p.filter("type = 'Point'").select("part_id", "feature_id", c[0].alias("px"), c[1].alias("py"), "attrs")


def line_parts(p: DataFrame) -> DataFrame:
    """``part_id, feature_id, x1, y1, x2, y2, attrs``: the ends of lines."""
    c = p.filter("type = 'LineString'").withColumn("c", F.from_json("coordinates", "array<array<double>>"))
    a, b = F.col("c")[0], F.element_at("c", -1)
    return c.select("part_id", "feature_id", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"), "attrs")


def polygon_parts(p: DataFrame) -> DataFrame:
    """``part_id, feature_id, boundary, area_m2, cx, cy, attrs``: outer ring as JSON text, area and centroid without the holes."""
    c = p.filter("type = 'Polygon'").withColumn("c", F.from_json("coordinates", "array<array<array<double>>>"))
    rings = c.select("part_id", F.posexplode("c").alias("ring", "r"))
    shift = F.col("r")[0]  # moments about the first vertex keep their digits
    cross = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(
        ((a[0] - shift[0]) * (b[1] - shift[1]) - (b[0] - shift[0]) * (a[1] - shift[1])).alias("k"), (a[0] + b[0] - 2 * shift[0]).alias("x"), (a[1] + b[1] - 2 * shift[1]).alias("y")))
    total = lambda f: F.aggregate("cross", F.lit(0.0), lambda s, t: s + f(t))
    m = rings.withColumn("cross", cross).select("part_id", "ring", shift[0].alias("ox"), shift[1].alias("oy"), total(lambda t: t["k"]).alias("k"), total(lambda t: t["k"] * t["x"]).alias("mx"), total(lambda t: t["k"] * t["y"]).alias("my"))
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0) * F.signum("k")
    a = F.col("k") / 2 * sign
    m = m.select("part_id", a.alias("a"), (F.col("mx") / 6 * sign + F.col("ox") * a).alias("x"), (F.col("my") / 6 * sign + F.col("oy") * a).alias("y"))
    m = m.groupBy("part_id").agg(F.sum("a").alias("a"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return c.select("part_id", "feature_id", F.to_json(F.col("c")[0]).alias("boundary"), "attrs").join(m, "part_id").select(
        "part_id", "feature_id", "boundary", F.round(F.col("a") * overlay.DEGREE_M * overlay.DEGREE_M, 1).alias("area_m2"), (F.col("x") / F.col("a")).alias("cx"), (F.col("y") / F.col("a")).alias("cy"), "attrs")


class Project:
    """A labelled graph and the layers attached to it."""

    def __init__(self, graph: Labelled, cell: float):
        self.graph, self.cell, self.tables, self.counts = graph, cell, {}, {}

    def add_layer(self, source: DataFrame | Path | str, name: str, snap_tolerance_m: float = 500.0) -> dict[str, int]:
        """Attach features (a table as ``layerfile.read_layer`` gives, or the path of a file) under a new name.

        Points beyond the tolerance stay and are marked.  Returns the counts by kind.  A name that is taken or a layer without
        features raises ValueError, a missing file FileNotFoundError, any other source TypeError.
        """
        if name in self.tables:
            raise ValueError(f"layer {name!r} is there already")
        if isinstance(source, str | Path):
            source = layerfile.read_layer(self.graph.nodes.sparkSession, str(source))
        elif not isinstance(source, DataFrame):
            raise TypeError(f"a layer is a table or a path, not {type(source).__name__}")
        if source.isEmpty():
            raise ValueError(f"layer {name!r} has no features")
        p, nodes, edges = keep(parts(source), "parts"), self.graph.nodes, self.graph.edges
        at = point_parts(p)
        snapped = overlay.snap(at.select(F.col("part_id").alias("point_id"), "px", "py"), nodes, self.cell, snap_tolerance_m).drop("d2").withColumnRenamed("point_id", "part_id")
        ends = line_parts(p)
        lines = overlay.snap_lines(ends.withColumnRenamed("part_id", "line_id").select("line_id", "x1", "y1", "x2", "y2"), nodes, edges, self.cell).withColumnRenamed("line_id", "part_id")
        tables = {"points": at.join(snapped, "part_id"), "lines": ends.join(lines, "part_id"), "polygons": polygon_parts(p)}
        tables = {kind: keep(t.withColumn("layer", F.lit(name)), kind) for kind, t in tables.items()}
        counts = {kind: t.count() for kind, t in tables.items()}
        self.counts[name] = counts | {"total": sum(counts.values()), "beyond_tolerance": tables["points"].filter("beyond_tolerance").count()}
        self.tables[name] = tables
        return self.counts[name]

    def get_layers(self) -> dict[str, dict[str, int]]:
        return dict(self.counts)

    def _get(self, kind: str, name: str | None) -> DataFrame | None:
        out = None
        for k, t in self.tables.items():
            if name in (None, k):
                out = t[kind] if out is None else out.unionByName(t[kind])
        return out

    def get_points(self, name: str | None = None) -> DataFrame | None:
        """Points of one layer or of all, with node_id, snap_dist_m, beyond_tolerance; None without layers."""
        return self._get("points", name)

    def get_lines(self, name: str | None = None) -> DataFrame | None:
        """Lines with su, sv; orphans, whose snapped ends no edge joins, too."""
        return self._get("lines", name)

    def get_polygons(self, name: str | None = None) -> DataFrame | None:
        return self._get("polygons", name)

    def summarise(self) -> str:
        if not self.counts:
            return "No project layers attached."
        rows = [f"  {k}: {c['points']} pts, {c['lines']} lines, {c['polygons']} polys ({c['total']} total)" + f"\n    ({c['beyond_tolerance']} beyond snap tolerance)" * bool(c["beyond_tolerance"]) for k, c in self.counts.items()]
        return "\n".join(["Project layers", *rows])
