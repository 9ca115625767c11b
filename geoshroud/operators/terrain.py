"""Outlines of masks, ring smoothing, a local projection, hulls, distances, and habitats from an elevation grid."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_M
from .iterate import keep, orbits
from .raster import erode, quantile_mask, regions

#: Sides of a pixel counter-clockwise: start corner, and the (row, col) steps to the neighbour beyond it.
SIDES = [((0, 0), (-1, 0)), ((0, 1), (0, 1)), ((1, 1), (1, 0)), ((1, 0), (0, -1))]


def mask_edges(mask: DataFrame) -> DataFrame:
    """``row, col, side, h``: the sides of mask pixels that have no mask pixel beyond."""
    m = mask.select("row", "col").distinct()
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), (F.col("row") + d[0]).alias("r2"), (F.col("col") + d[1]).alias("c2")) for i, (_, d) in enumerate(SIDES)])).alias("s")
    beyond = m.select(F.col("row").alias("r2"), F.col("col").alias("c2"))
    e = m.select("row", "col", sides).select("row", "col", "s.*").join(beyond, ["r2", "c2"], "left_anti")
    return e.select("row", "col", "side", ((F.col("row") * (1 << 29) + F.col("col")) * 4 + F.col("side")).alias("h"))


def mask_rings(mask: DataFrame) -> DataFrame:
    """``ring, h, x, y, x2, y2``: the directed outline of every 4-connected region, pixel (r, c) being [c, c+1] x [r, r+1].

    Outer rings run counter-clockwise, holes clockwise; where two pixels touch at a corner only, each keeps its own ring.  After a
    side comes the next side of the same pixel, else a side of the neighbour beyond that, else of the one diagonally ahead; rings
    are the orbits of that rule.
    """
    e = keep(mask_edges(mask), "outline")
    tries = []
    for i, (_, d) in enumerate(SIDES):
        ahead = SIDES[(i + 1) % 4][1]
        tries += [(i, 0, (0, 0), (i + 1) % 4), (i, 1, ahead, i), (i, 2, (ahead[0] + d[0], ahead[1] + d[1]), (i + 3) % 4)]
    options = F.explode(F.array(*[F.when(F.col("side") == i, F.struct(F.lit(p).alias("p"), (F.col("row") + s[0]).alias("row"), (F.col("col") + s[1]).alias("col"), F.lit(t).alias("side"))) for i, p, s, t in tries])).alias("o")
    want = e.select("h", options).filter("o is not null").select("h", "o.*")
    found = want.join(e.withColumnRenamed("h", "n"), ["row", "col", "side"])
    succ = found.groupBy("h").agg(F.min_by("n", "p").alias("n"))
    corner = lambda axis, side: F.element_at(F.array(*[F.lit(c[axis]) for c, _ in SIDES]), side % 4 + 1)
    at = lambda axis, side: (F.col("row" if axis == 0 else "col") + corner(axis, side)).cast("double")
    side = F.col("side")
    return e.join(orbits(succ), "h").select(F.col("orbit").alias("ring"), "h", "row", "col", at(1, side).alias("x"), at(0, side).alias("y"), at(1, side + 1).alias("x2"), at(0, side + 1).alias("y2"))


def region_outlines(mask: DataFrame) -> DataFrame:
    """``region, n_rings, perimeter, area``: of every 4-connected region; holes count as rings and against the area."""
    r = mask_rings(mask).join(regions(mask), ["row", "col"])
    return r.groupBy("region").agg(F.countDistinct("ring").alias("n_rings"), F.count("*").alias("perimeter"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"))


def smooth(rings: DataFrame, sigma: float) -> DataFrame:
    """Rings ``poly_id, pos, x, y`` with every vertex replaced by the Gaussian mean of those around it, across the closure."""
    reach = max(1, int(4 * sigma + 0.5))
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v / sum(w)).alias("w")) for k, v in zip(range(-reach, reach + 1), w)])).alias("g")
    n = rings.groupBy("poly_id").agg(F.count("*").alias("m"))
    s = rings.join(n, "poly_id").select("poly_id", "m", "pos", "x", "y", spread)
    s = s.select("poly_id", F.pmod(F.col("pos") + F.col("g.k"), F.col("m")).alias("pos"), (F.col("x") * F.col("g.w")).alias("x"), (F.col("y") * F.col("g.w")).alias("y"))
    return s.groupBy("poly_id", "pos").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def to_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """struct<x,y>: azimuthal equidistant projection of the sphere about (lon0, lat0)."""
    p, p0, d = F.radians(lat), F.lit(math.radians(lat0)), F.radians(lon - lon0)
    cos_c = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
    k = F.when(F.sin(c) == 0, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_M
    return F.struct((k * F.cos(p) * F.sin(d)).alias("x"), (k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))).alias("y"))


def to_degrees(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """struct<lon,lat>: the inverse of ``to_metres``."""
    p0, r = F.lit(math.radians(lat0)), F.sqrt(x * x + y * y)
    c = r / EARTH_M
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(c) * F.sin(p0) + F.when(r == 0, F.lit(0.0)).otherwise(y * F.sin(c) * F.cos(p0) / r))))
    lon = F.lit(lon0) + F.degrees(F.atan2(x * F.sin(c), r * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c)))
    return F.struct(F.when(r == 0, F.lit(lon0)).otherwise(lon).alias("lon"), F.when(r == 0, F.lit(lat0)).otherwise(F.degrees(lat)).alias("lat"))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for run in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in run:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def hull(points: DataFrame, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``pos, x, y``: the convex hull of all points, by hulls of batches and then of what they leave."""

    def partial(batches):
        for b in batches:
            yield pd.DataFrame(_hull(list(zip(b["x"], b["y"]))), columns=["x", "y"])

    def whole(batches):
        held: list[tuple[float, float]] = []
        for b in batches:
            held = _hull(held + list(zip(b["x"], b["y"])))
        yield pd.DataFrame([(i, *p) for i, p in enumerate(held)], columns=["pos", "x", "y"])

    p = points.select(F.col(columns[0]).cast("double").alias("x"), F.col(columns[1]).cast("double").alias("y")).dropna()
    return p.mapInPandas(partial, "x double, y double").mapInPandas(partial, "x double, y double").coalesce(1).mapInPandas(whole, "pos long, x double, y double")


def extent(*layers: DataFrame) -> DataFrame:
    """One row ``west, south, east, north`` over the x and y of all layers."""
    each = None
    for t in layers:
        e = t.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
        each = e if each is None else each.unionByName(e)
    return each.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def near_points(pixels: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """``row, col`` of the pixels whose centre is within ``radius`` (in pixels) of a point x, y; points meet pixels by grid cell."""
    cell = max(1.0, radius)
    g = lambda c: F.floor(c / cell)
    p = points.select("x", "y", F.explode(F.sequence(g(F.col("x") - radius), g(F.col("x") + radius))).alias("gx"))
    p = p.select("x", "y", "gx", F.explode(F.sequence(g(F.col("y") - radius), g(F.col("y") + radius))).alias("gy"))
    q = pixels.select("row", "col", (F.col("col") + 0.5).alias("px"), (F.col("row") + 0.5).alias("py"))
    q = q.select("*", g(F.col("px")).alias("gx"), g(F.col("py")).alias("gy"))
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    return q.join(p, ["gx", "gy"]).filter(d2 <= radius * radius).select("row", "col").distinct()


def near_segments(pixels: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """``row, col`` of the pixels whose centre is within ``radius`` of a segment x1, y1, x2, y2; long segments are cut by cell first."""
    cell = max(4.0, 2 * radius)
    cuts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / cell).cast("int"))
    s = segments.select("x1", "y1", "x2", "y2", cuts.alias("cuts")).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("cuts"))
    s = s.select(at("x1", "x2", F.col("i")).alias("ax"), at("y1", "y2", F.col("i")).alias("ay"), at("x1", "x2", F.col("i") + 1).alias("bx"), at("y1", "y2", F.col("i") + 1).alias("by"))
    g = lambda c: F.floor(c / cell)
    s = s.select("*", F.explode(F.sequence(g(F.least("ax", "bx") - radius), g(F.greatest("ax", "bx") + radius))).alias("gx"))
    s = s.select("*", F.explode(F.sequence(g(F.least("ay", "by") - radius), g(F.greatest("ay", "by") + radius))).alias("gy"))
    q = pixels.select("row", "col", (F.col("col") + 0.5).alias("px"), (F.col("row") + 0.5).alias("py"))
    q = q.select("*", g(F.col("px")).alias("gx"), g(F.col("py")).alias("gy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    t = F.when(dx * dx + dy * dy == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    ex, ey = F.col("px") - F.col("ax") - t * dx, F.col("py") - F.col("ay") - t * dy
    return q.join(s, ["gx", "gy"]).filter(ex * ex + ey * ey <= radius * radius).select("row", "col").distinct()


def largest_regions(mask: DataFrame, most: int | None = None, min_pixels: int = 1) -> DataFrame:
    """``row, col, region, place, n_pixels``: regions by size (ties: the least pixel), at most ``most``, none under ``min_pixels``."""
    r = keep(regions(mask), "regions")
    size = r.groupBy("region").agg(F.count("*").alias("n_pixels")).filter(F.col("n_pixels") >= min_pixels)
    top = size.orderBy(F.desc("n_pixels"), "region").limit(most) if most else size
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_pixels"), "region")) - 1)  # one row a region
    return r.join(top, "region").select("row", "col", "region", "place", "n_pixels")


def habitats(dem: DataFrame, settlements: DataFrame, roads: DataFrame, land_z: float = 0.0, high: float = 0.88, band: tuple[float, float] = (0.2, 0.6), coast: float = 3.0, avoid: tuple[float, float, float] = (4.0, 2.0, 1.0), min_pixels: int = 4) -> DataFrame:
    """``row, col, species, habitat_id, n_pixels``: disjoint habitats on land (z above ``land_z``).

    Mountains: the five largest regions of the eroded top quantile.  Coast: the three largest regions of land within ``coast`` pixels
    of other pixels, away from settlements.  Valleys: the two largest regions of the middle band, away from settlements and roads.
    Mountains win over coast, coast over valleys; what that leaves under ``min_pixels`` goes.  Distances are in pixels: (coast to
    settlements, valley to settlements, valley to roads).
    """
    dem = keep(dem, "dem")
    land = keep(dem.filter(F.col("z") > land_z).select("row", "col"), "land")
    far = lambda m, near: m.join(near, ["row", "col"], "left_anti")
    mountain = largest_regions(erode(quantile_mask(dem, high), 3), 5).select("row", "col")
    shore = mask_edges(land).select((F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y")).distinct()
    strip = far(near_points(land, shore, coast), near_points(land, settlements, avoid[0]))
    strip = largest_regions(strip, 3).select("row", "col")
    valley = far(far(quantile_mask(dem, *band).select("row", "col"), near_points(dem, settlements, avoid[1])), near_segments(dem, roads, avoid[2]))
    valley = largest_regions(valley, 2).select("row", "col")
    out, taken = None, None
    for species, code, m in (("mountain", "MOU", mountain), ("coast", "COA", strip), ("valley", "VAL", valley)):
        m = keep(m.join(land, ["row", "col"], "left_semi"), "clipped")
        if taken is not None:
            m = far(m, taken)
        got = keep(largest_regions(m, None, min_pixels), "habitat")
        taken = got.select("row", "col") if taken is None else taken.unionByName(got.select("row", "col"))
        got = got.select("row", "col", F.lit(species).alias("species"), F.format_string(f"{code}-%02d", F.col("place")).alias("habitat_id"), "n_pixels")
        out = got if out is None else out.unionByName(got)
    return out
