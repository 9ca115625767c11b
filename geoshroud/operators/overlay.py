"""Project layers on a graph: nearest-node snapping, line and polygon storage, layer registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEGREE_M = 111_000.0


def snap(points: DataFrame, nodes: DataFrame, cell: float, tolerance_m: float = 500.0) -> DataFrame:
    """Rows ``point_id, px, py`` with their nearest node (ties: the least id): ``node_id, snap_dist_m, beyond_tolerance``.

    Nodes are bucketed on a grid of ``cell``; a point looks at its 3x3 cells, and if the best of those is not surely the
    nearest (farther than the ring's inner radius), it looks again on a grid twice as coarse, until all are settled.
    """
    todo, out, width = points.select("point_id", "px", "py"), None, cell
    box = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return points.sparkSession.createDataFrame([], "point_id long, node_id long, d2 double, snap_dist_m double, beyond_tolerance boolean")
    far = points.agg(F.max(F.greatest(F.abs("px"), F.abs("py")))).first()[0] or 0.0
    whole = 2 * (max(map(abs, box)) + far) + cell
    while True:
        last = width > whole
        g = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        n = nodes.select("node_id", "x", "y", g("x").alias("gx"), g("y").alias("gy"))
        p = todo.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"))
        p = p.select("point_id", "px", "py", (g("px") + F.col("i")).alias("gx"), (g("py") + F.col("j")).alias("gy"))
        d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
        best = p.join(n, ["gx", "gy"]).groupBy("point_id").agg(F.min(F.struct(d2.alias("d2"), F.col("node_id").alias("node_id"))).alias("b")).select("point_id", "b.*")
        if not last:
            best = best.filter(F.col("d2") < width * width)
        out = best if out is None else out.unionByName(best)
        if last:
            break
        left = todo.join(best.select("point_id"), "point_id", "left_anti")
        if left.isEmpty():
            break
        todo, width = left, width * 2
    m = F.sqrt("d2") * DEGREE_M
    return out.withColumn("snap_dist_m", F.round(m, 1)).withColumn("beyond_tolerance", m > tolerance_m)


def snap_lines(lines: DataFrame, nodes: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Rows ``line_id, x1, y1, x2, y2`` with ``su, sv, orphan``: the edge between the snapped ends, or none."""
    a = snap(lines.select(F.col("line_id").alias("point_id"), F.col("x1").alias("px"), F.col("y1").alias("py")), nodes, cell)
    b = snap(lines.select(F.col("line_id").alias("point_id"), F.col("x2").alias("px"), F.col("y2").alias("py")), nodes, cell)
    j = a.select("point_id", F.col("node_id").alias("a")).join(b.select("point_id", F.col("node_id").alias("b")), "point_id")
    j = j.select(F.col("point_id").alias("line_id"), F.least("a", "b").alias("su"), F.greatest("a", "b").alias("sv"))
    e = edges.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.lit(True).alias("hit"))
    return j.join(e, ["su", "sv"], "left").select("line_id", "su", "sv", F.col("hit").isNull().alias("orphan"))


def polygon_store(rings: DataFrame) -> DataFrame:
    """Rows ``poly_id, pos, x, y`` (open rings) to ``poly_id, n_vertices, area_m2, cx, cy`` (area-weighted centroid)."""
    n = rings.groupBy("poly_id").agg(F.count("*").alias("n_vertices"))
    nxt = rings.join(n, "poly_id").select("poly_id", "n_vertices", "pos", "x", "y", F.pmod(F.col("pos") + 1, F.col("n_vertices")).alias("np"))
    b = rings.select("poly_id", F.col("pos").alias("np"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    c = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    s = nxt.join(b, ["poly_id", "np"]).groupBy("poly_id").agg(F.first("n_vertices").alias("n_vertices"), F.sum(c).alias("c"), F.sum((F.col("x") + F.col("x2")) * c).alias("sx"), F.sum((F.col("y") + F.col("y2")) * c).alias("sy"))
    return s.select("poly_id", "n_vertices", F.round(F.abs("c") * 0.5 * DEGREE_M * DEGREE_M, 1).alias("area_m2"), (F.col("sx") / (F.col("c") * 3)).alias("cx"), (F.col("sy") / (F.col("c") * 3)).alias("cy"))


class Layers:
    """Registry of named layers; every table has a column ``layer`` for pruning."""

    def __init__(self):
        self.tables: dict[str, dict[str, DataFrame]] = {}

    def add(self, name: str, kind: str, df: DataFrame) -> int:
        if name in self.tables:
            raise ValueError(f"layer {name!r} already exists")
        if not isinstance(df, DataFrame):
            raise TypeError("a layer is a DataFrame")
        n = df.count()
        if not n:
            raise ValueError(f"layer {name!r} has no features")
        self.tables[name] = {kind: df.withColumn("layer", F.lit(name))}
        return n

    def get(self, kind: str, name: str | None = None) -> list[DataFrame]:
        return [t[kind] for k, t in self.tables.items() if kind in t and name in (None, k)]

    def summarise(self) -> str:
        if not self.tables:
            return "No project layers attached."
        return "\n".join(f"{k}: {kind} {df.count()}" for k, t in self.tables.items() for kind, df in t.items())
