"""Any source to one labelled simple graph, with its summary, conditions, attribute payload and checksum."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions.geometry import euclid
from . import canon, graph
from .iterate import components, keep

CRS = "EPSG:4326"


@dataclass(frozen=True)
class Simple:
    """A pre-built graph: nodes (node_id and any of x, y, lon, lat) and edges (u, v and maybe length)."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Multi:
    """A road dump: nodes (node_id, x, y) and rows u, v, length, seq, which may repeat and point both ways."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Labelled:
    """Nodes (node_id from 0, original_id, x, y and attributes), edges (u <= v, length and attributes), and what they came from."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)


def _first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there and not null, else 0."""
    return F.coalesce(*[F.col(c) for c in names if c in df.columns], F.lit(0.0)).cast("double")


def _finish(nodes: DataFrame, edges: DataFrame, source: str) -> Labelled:
    """Ranks for ids, lengths where there are none."""
    ranks = keep(graph.relabel(nodes.select("node_id"), edges.select("u", "v"))[0], "ranks")
    n = nodes.withColumnRenamed("node_id", "original_id").join(ranks, "original_id")
    at = lambda e: ranks.select(F.col("original_id").alias(e), F.col("node_id").alias(e + "_"))
    e = edges.join(at("u"), "u").join(at("v"), "v").drop("u", "v").select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v"), *[F.col(c) for c in edges.columns if c not in ("u", "v")])
    if "length" not in e.columns:
        e = e.withColumn("length", F.lit(None).cast("double"))
    ends = graph.with_ends(e, n)
    e = ends.withColumn("length", F.coalesce("length", euclid(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))).select(*e.columns)
    return Labelled(n, e, {"source": source, "crs": CRS})


def to_labelled(source: Simple | Multi | DataFrame) -> Labelled:
    """A simple graph, a multigraph or a table of lines (line_id, path array<struct<x,y>>, attributes) as a labelled graph.

    Coordinates fall back from x, y to lon, lat and then 0; missing lengths are straight-line distances.  Of parallel rows the
    shortest stays.  A line is an edge between its end points, first seen first numbered; its length is that of its path; rows
    that join a point to itself or repeat a pair leave only their points.  Lines without any edge raise ValueError, anything
    else TypeError.
    """
    if isinstance(source, Simple):
        n = source.nodes
        return _finish(n.withColumn("x", _first_of(n, "x", "lon")).withColumn("y", _first_of(n, "y", "lat")).drop("lon", "lat"), source.edges, "pre-built")
    if isinstance(source, Multi):
        e = keep(graph.collapse(source.edges), "collapsed")
        used = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
        n = used.join(source.nodes, "node_id", "left")
        return _finish(n.withColumn("x", _first_of(n, "x")).withColumn("y", _first_of(n, "y")), e, "roads")
    if isinstance(source, DataFrame):
        rest = [c for c in source.columns if c not in ("line_id", "path")]
        lines = source.filter(F.size("path") > 0)
        p, q = F.col("path")[0], F.element_at("path", -1)
        ends = lines.select("line_id", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
        nodes, edges = graph.lines_to_graph(ends)
        edges = keep(edges.select("u", "v", "line_id"), "line-edges")
        if edges.isEmpty():
            raise ValueError("no line joins two different points")
        step = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: euclid(a["x"], a["y"], b["x"], b["y"]))
        about = lines.select("line_id", F.aggregate(step, F.lit(0.0), lambda s, d: s + d).alias("length"), *rest)
        return Labelled(nodes.withColumn("original_id", F.col("node_id")), edges.join(about, "line_id").drop("line_id"), {"source": "lines", "crs": CRS})
    raise TypeError(f"a graph is not made from {type(source).__name__}")


def largest(g: Labelled) -> Labelled:
    """The component of most nodes, numbered anew from 0."""
    n, e = graph.largest_component(g.nodes, g.edges)
    return _finish(n.drop("original_id"), e, g.meta.get("source", "unknown"))


def facts(g: Labelled, by: str = "road_class") -> DataFrame:
    """One row: n_nodes, n_edges, n_components, bounding box, length statistics and the classes' counts as text."""
    c = components(g.nodes, g.edges).agg(F.countDistinct("component").alias("n_components"))
    s = graph.summary(g.nodes, g.edges, g.edges)
    kind = F.coalesce(F.col(by), F.lit("unknown")) if by in g.edges.columns else F.lit("unknown")
    k = g.edges.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "k", F.col("n").cast("string")))), ", ").alias("classes"))  # a row for each class
    return s.join(c).join(k)  # one row each


def summary_text(g: Labelled, planar: bool | None = None) -> str:
    """The facts as lines of text; ``planar`` is shown if it was tested."""
    r = facts(g).first()
    out = ["Graph summary", f"source: {g.meta.get('source', 'unknown')}", f"crs: {g.meta.get('crs', 'unknown')}", f"nodes: {r.n_nodes}", f"edges: {r.n_edges}", f"components: {r.n_components}"]
    if planar is not None:
        out.append(f"planar: {planar}")
    if r.n_nodes:
        out += [f"x: [{r.west:.6f}, {r.east:.6f}]", f"y: [{r.south:.6f}, {r.north:.6f}]"]
    if r.n_edges:
        out += [f"lengths: min={r.min_length:.1f}, max={r.max_length:.1f}, mean={r.mean_length:.1f}", f"road classes: {r.classes}"]
    return "\n".join(out)


def require_connected(g: Labelled) -> Labelled:
    """The graph itself; ValueError if it has no node or more than one component."""
    n = components(g.nodes, g.edges).select("component").distinct().limit(2).count()
    if n != 1:
        raise ValueError("the graph is not connected" if n else "the graph has no nodes")
    return g


def payload(df: DataFrame, *without: str) -> Column:
    """JSON text of a row's attributes in the order of their names: numbers, texts, booleans and nulls as they are (null ones
    are left out, as to_json does), everything else as text."""
    plain = ("string", "boolean", "byte", "short", "int", "long", "float", "double", "tinyint", "smallint", "bigint")
    kinds = dict(df.dtypes)
    cols = [F.col(c) if kinds[c] in plain else F.col(c).cast("string").alias(c) for c in sorted(df.columns) if c not in without]
    return F.to_json(F.struct(*cols)) if cols else F.lit("{}")


def attribute_hash(g: Labelled) -> DataFrame:
    """One row ``attribute_hash`` over the attributes of all nodes and edges."""
    n = g.nodes.select(F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("k"), payload(g.nodes, "node_id").alias("j"))
    e = g.edges.select(F.concat(F.lit("e"), F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))).alias("k"), payload(g.edges, "u", "v").alias("j"))
    return canon.attribute_hash(n.unionByName(e), "k", "j")


def checksum(g: Labelled, key: bytes) -> DataFrame:
    """One row ``graph_hash, attribute_hash, checksum``: the keyed binding of structure and attributes."""
    h = canon.wl_graph_hash(canon.wl_labels(g.nodes, g.edges)).join(attribute_hash(g))  # one row each
    return h.withColumn("checksum", keyed.checksum_column(key, F.col("graph_hash"), F.col("attribute_hash")))
