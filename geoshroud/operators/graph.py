"""Graph normalisation: raw roads to labelled simple graphs, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import euclid
from .iterate import components


def with_ends(edges: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``edges`` with ux, uy, vx, vy."""
    at = lambda e: nodes.select(F.col("node_id").alias(e), F.col(x).alias(e + "x"), F.col(y).alias(e + "y"))
    return edges.join(at("u"), "u").join(at("v"), "v")


def edge_lengths(edges: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``u, v, length``: Euclidean length of every edge."""
    return with_ends(edges, nodes, x, y).select("u", "v", euclid(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")).alias("length"))


def relabel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node ids replaced by their 0-based rank, as ``node_map`` (original_id, node_id) and edges.

    Ranks are built from counts of id ranges, so no task sees all nodes.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = nodes.select(F.col("node_id").alias("original_id"))
    lo, hi = ids.agg(F.min("original_id"), F.max("original_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // parts + 1)
    ids = ids.withColumn("b", F.floor((F.col("original_id") - F.lit(lo or 0)) / width))
    sizes = ids.groupBy("b").agg(F.count("*").alias("k")).withColumn("base", F.sum("k").over(Window.orderBy("b")) - F.col("k")).select("b", "base")  # one row a range
    rank = F.row_number().over(Window.partitionBy("b").orderBy("original_id")) - 1
    m = ids.withColumn("r", rank).join(F.broadcast(sizes), "b").select("original_id", (F.col("r") + F.col("base")).cast("long").alias("node_id"))
    to = lambda e: m.select(F.col("original_id").alias(e), F.col("node_id").alias(e + "_id"))
    return m, edges.join(to("u"), "u").join(to("v"), "v").select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"))


def collapse(raw: DataFrame) -> DataFrame:
    """Multigraph rows ``u, v, length, seq`` and others to one row for each unordered pair: the shortest, missing lengths
    last, the first on ties."""
    key = F.struct(F.coalesce("length", F.lit(float("inf"))), F.col("seq"))
    rest = [c for c in raw.columns if c not in ("u", "v")]
    return raw.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min_by(F.struct(*rest), key).alias("r"), F.count("*").alias("parallels")).select("u", "v", "r.*", "parallels")


def merge_attributes(raw: DataFrame) -> DataFrame:
    """As ``collapse`` for rows with a map ``attrs``: each strictly shorter row is merged over what came before."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("length", F.lit(float("inf"))).alias("length"), F.map_entries("attrs").alias("attrs"))))
    start = F.struct(F.lit(float("inf")).alias("length"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attrs"), F.lit(True).alias("fresh"))

    def step(acc, r):
        over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
        win = (r["length"] < acc["length"]) | acc["fresh"]
        return F.struct(F.when(win, r["length"]).otherwise(acc["length"]).alias("length"), F.when(win, over(acc["attrs"], F.map_from_entries(r["attrs"]))).otherwise(acc["attrs"]).alias("attrs"), F.lit(False).alias("fresh"))

    g = raw.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(rows.alias("rows"))
    return g.select("u", "v", F.aggregate("rows", start, step).alias("r")).select("u", "v", F.when(~F.col("r.length").isin(float("inf")), F.col("r.length")).alias("length"), "r.attrs")


def lines_to_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``line_id, x1, y1, x2, y2`` to ``nodes`` (ids in order of first sight) and the first edge of every pair.

    Self-loops and repeats are skipped, but their end points stay.
    """
    z = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))  # noqa: E731  -0.0 is 0.0
    l = lines.select("line_id", *[z(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    ends = l.select("line_id", F.lit(0).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(l.select("line_id", F.lit(1), "x2", "y2"))
    first = ends.groupBy("x", "y").agg(F.min(F.col("line_id") * 2 + F.col("pos")).alias("node_id"))
    m, _ = relabel(first, l.select(F.lit(0).alias("u"), F.lit(0).alias("v")).limit(0))
    nodes = first.join(m.withColumnRenamed("node_id", "rank"), first["node_id"] == m["original_id"]).select(F.col("rank").alias("node_id"), "x", "y")
    a = nodes.select(F.col("node_id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = l.join(a, ["x1", "y1"]).join(b, ["x2", "y2"]).filter("a <> b")
    e = e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min_by(F.struct("line_id", euclid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("length")), "line_id").alias("r"))
    return nodes, e.select("u", "v", "r.line_id", "r.length")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, degree``; a self-loop counts twice, isolated nodes have 0."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"))
    d = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_sequence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component of most nodes (ties: the least id)."""
    c = components(nodes, edges)
    top = c.groupBy("component").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "component").limit(1)
    kept = c.join(F.broadcast(top.select("component")), "component", "left_semi").select("node_id")
    e = edges.join(kept.select(F.col("node_id").alias("u")), "u", "left_semi").join(kept.select(F.col("node_id").alias("v")), "v", "left_semi")
    return nodes.join(kept, "node_id", "left_semi"), e


def summary(nodes: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: counts, bounding box and length statistics."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    e = lengths.agg(F.count("*").alias("n_edges"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 6).alias("mean_length"))
    return n.join(e)  # one row each
