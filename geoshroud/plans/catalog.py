"""Registered queries of the map engine, and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keyed
from ..functions.geometry import geodetic_area, haversine
from ..operators import boundary, canon, faces, graph, network, overlay, raster, reembed, spectral, verify
from ..operators.iterate import components, keep
from ..sources import geojson, svg
from .inputs import Inputs, with_inputs

KEY = bytes(range(32))
IPAD, OPAD = (p.hex() for p in keyed.pads(KEY))
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of Inputs under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def mac(message: str) -> str:
    """DuckDB expression of the hex HMAC of a blob expression."""
    return f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || {message})))"


def be(n: str) -> str:
    return f"unhex(printf('%016x', {n}))"


def unit(d: str, at: int) -> str:
    return f"(CAST(CAST(CONCAT('0x', substr({d}, {2 * at + 1}, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE)"


LEN = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
LENS = f"lens AS (SELECT u, v, {LEN} AS length FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v), lens2 AS (SELECT u, v, {LEN} AS length FROM edges JOIN moved a ON a.node_id = u JOIN moved b ON b.node_id = v)"
ERRS = LENS + ", errs AS (SELECT lens.u, lens.v, (lens2.length - lens.length) / lens.length AS err FROM lens JOIN lens2 USING (u, v) WHERE lens.length > 1e-12)"


@query(with_inputs(LENS + " SELECT u, v, length FROM lens", "edges"  , "moved"))
def edge_lengths(i):
    return graph.edge_lengths(i.edges, i.nodes)


@query(with_inputs(LENS + " SELECT count(*) AS n_edges, min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS mean_length, any_value(n.c) AS n_nodes, any_value(n.west) AS west, any_value(n.south) AS south, any_value(n.east) AS east, any_value(n.north) AS north FROM lens, (SELECT count(*) AS c, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM nodes) n", "edges", "moved"))
def graph_summary(i):
    return graph.summary(i.nodes, i.edges, graph.edge_lengths(i.edges, i.nodes))


@query(with_inputs("SELECT road_class, count(*) AS n FROM edges GROUP BY road_class", "edges"))
def road_class_hist(i):
    return i.edges.groupBy("road_class").agg(F.count("*").alias("n"))


def _errors(i):
    return verify.length_errors(graph.edge_lengths(i.edges, i.nodes), graph.edge_lengths(i.edges, i.moved))


@query(with_inputs(ERRS + " SELECT count(*) AS n_edges, round(avg(abs(err)), 6) AS length_mean_rel_error, round(max(abs(err)), 6) AS length_max_rel_error, bool_and(abs(err) <= 0.01) AS length_within_tol FROM errs", "edges", "moved"))
def length_metrics(i):
    return verify.length_metrics(_errors(i))


@query(with_inputs(ERRS + ", lim AS (SELECT min(err) AS lo, max(err) AS hi FROM errs) SELECT CAST(least(49, floor((err - lo) / (hi - lo) * 50)) AS BIGINT) AS bin, count(*) AS n FROM errs, lim GROUP BY 1", "edges", "moved"))
def length_error_hist(i):
    return verify.error_histogram(_errors(i))


@query(with_inputs("SELECT count(*) AS n_nodes, bool_and(abs(nodes.x - moved.x) <= 1e-10 + 1e-5 * abs(moved.x) AND abs(nodes.y - moved.y) <= 1e-10 + 1e-5 * abs(moved.y)) AS same FROM nodes JOIN moved USING (node_id)", "moved"))
def round_trip(i):
    return verify.round_trip(i.nodes, i.moved)


DEG = "deg AS (SELECT node_id, count(n) AS degree FROM nodes LEFT JOIN (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) q ON n = node_id GROUP BY node_id)"


@query(with_inputs(DEG + " SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree", "edges"))
def degree_sequence(i):
    return graph.degree_sequence(i.nodes, i.edges)


@query(f"SELECT p_partkey AS id, {unit('d', 0)} AS x, {unit('d', 8)} AS y FROM (SELECT p_partkey, {mac(be('p_partkey'))} AS d FROM part) q")
def prf_coordinates(i):
    return i.table("part").select(F.col("p_partkey").alias("id"), keyed.prf_coordinates(KEY, F.col("p_partkey")).alias("c")).select("id", "c.x", "c.y")


@query(f"SELECT face, k, round(2 * pi() * {unit('d', 0)}, 9) AS phase FROM (SELECT s_suppkey AS face, k, {mac(be('s_suppkey') + ' || ' + be('k'))} AS d FROM supplier, range(8) t(k)) q")
def keyed_phases(i):
    t = i.table("supplier").select(F.col("s_suppkey").alias("face"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return t.select("face", F.col("k").cast("long").alias("k"), F.round(keyed.keyed_phase(KEY, F.col("face"), F.col("k")), 9).alias("phase"))


@query(f"SELECT n_nationkey, {mac('encode(n_name || chr(124) || CAST(n_regionkey AS VARCHAR))')} AS checksum FROM nation")
def checksums(i):
    return i.table("nation").select("n_nationkey", keyed.checksum_column(KEY, F.col("n_name"), F.col("n_regionkey").cast("string")).alias("checksum"))


@query(with_inputs("SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(length, (length, seq)) AS length, arg_min(seq, (length, seq)) AS seq, arg_min(flag, (length, seq)) AS flag, count(*) AS parallels FROM raw GROUP BY 1, 2", "raw"))
def multigraph_collapse(i):
    return graph.collapse(i.raw)


@query(with_inputs("ids AS (SELECT DISTINCT v AS original_id FROM raw UNION SELECT u FROM raw) SELECT original_id, row_number() OVER (ORDER BY original_id) - 1 AS node_id FROM ids", "raw"))
def relabel_nodes(i):
    ids = i.raw.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return graph.relabel(ids, i.raw.select("u", "v"))[0]


L2G = "ends AS (SELECT x1 AS x, y1 AS y, 2 * line_id AS s FROM lines UNION ALL SELECT x2, y2, 2 * line_id + 1 FROM lines), nd AS (SELECT x, y, row_number() OVER (ORDER BY min(s)) - 1 AS node_id FROM ends GROUP BY x, y), e AS (SELECT line_id, least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM lines JOIN nd a ON a.x = x1 AND a.y = y1 JOIN nd b ON b.x = x2 AND b.y = y2 WHERE a.node_id <> b.node_id)"


@query(with_inputs(L2G + " SELECT u, v, min(line_id) AS line_id, arg_min(length, line_id) AS length FROM e GROUP BY u, v", "lines"))
def lines_to_graph(i):
    return graph.lines_to_graph(i.lines)[1]


COMP = (
    "both_ AS (SELECT u, v FROM trade UNION ALL SELECT v, u FROM trade), reach AS (SELECT node_id, node_id AS c FROM traders UNION SELECT both_.v, reach.c FROM reach JOIN both_ ON both_.u = reach.node_id WHERE reach.c < both_.v)"
    ", comp AS (SELECT node_id, min(c) AS component FROM reach GROUP BY node_id)"
)


@query(with_inputs(COMP + " SELECT node_id, component FROM comp", "trade", recursive=True))
def graph_components(i):
    return components(i.traders, i.trade)


@query(with_inputs(COMP + ", top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT u, v FROM trade JOIN comp ON u = node_id WHERE component IN (SELECT component FROM top)", "trade", recursive=True))
def largest_component_edges(i):
    return graph.largest_component(i.traders, i.trade)[1]


# the whole lattice: one large component with long paths, for which the recursive SQL would have a row per pair of nodes
@query()
def graph_components_whole(i):
    return components(i.nodes, i.edges)


@query()
def largest_component_edges_whole(i):
    return graph.largest_component(i.nodes, i.edges)[1]


WL = DEG + ", bothw AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), l0 AS (SELECT node_id, degree, CAST(degree AS VARCHAR) AS label FROM deg)" + "".join(
    f", l{r + 1} AS MATERIALIZED (SELECT a.node_id, any_value(a.degree) AS degree, substr(md5(any_value(a.label) || '|' || coalesce(string_agg(b.label, ',' ORDER BY b.label), '')), 1, 8) AS label FROM l{r} a LEFT JOIN bothw ON u = a.node_id LEFT JOIN l{r} b ON b.node_id = v GROUP BY a.node_id)" for r in range(5)
)


@query(with_inputs(WL + " SELECT node_id, degree, label FROM l5", "edges"))
def wl_labels(i):
    return canon.wl_labels(i.nodes, i.edges)


@query(with_inputs(WL + " SELECT node_id, row_number() OVER (ORDER BY degree, label, CAST(node_id AS VARCHAR)) - 1 AS rank FROM l5", "edges"))
def canonical_order(i):
    return canon.canonical_order(canon.wl_labels(i.nodes, i.edges))


@query(with_inputs(WL + " SELECT sha256(string_agg(t, ',' ORDER BY t)) AS graph_hash FROM (SELECT label || ':' || CAST(count(*) AS VARCHAR) AS t FROM l5 GROUP BY label) q", "edges"))
def wl_graph_hash(i):
    return canon.wl_graph_hash(canon.wl_labels(i.nodes, i.edges))


@query("SELECT sha256(string_agg(t, '' ORDER BY t)) AS attribute_hash FROM (SELECT p || sha256(string_agg(h, '' ORDER BY h)) AS t FROM (SELECT substr(h, 1, 2) AS p, h FROM (SELECT sha256(CAST(event_id AS VARCHAR) || '=' || props) AS h FROM events) a) b GROUP BY p) c")
def attribute_json_hash(i):
    return canon.attribute_hash(i.table("events"), "event_id", "props")


#: Rotation systems and orbits by pointer doubling, 13 levels: cycles of up to 8192 half-edges.
FACES = (
    "he AS MATERIALIZED (SELECT u, v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, u * 2147483648 + v AS h FROM (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) q JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)"
    ", rot AS MATERIALIZED (SELECT *, coalesce(lag(v) OVER w, last_value(v) OVER (PARTITION BY u ORDER BY atan2(vy - uy, vx - ux), v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cw FROM he WINDOW w AS (PARTITION BY u ORDER BY atan2(vy - uy, vx - ux), v))"
    ", o0 AS MATERIALIZED (SELECT v * 2147483648 + u AS h, u * 2147483648 + cw AS n, least(v * 2147483648 + u, u * 2147483648 + cw) AS m FROM rot)"
    + "".join(f", o{k + 1} AS MATERIALIZED (SELECT a.h, b.n, least(a.m, b.m) AS m FROM o{k} a JOIN o{k} b ON b.h = a.n)" for k in range(13))
    + ", half AS MATERIALIZED (SELECT rot.*, m AS face FROM rot JOIN o13 USING (h)), fa AS (SELECT face, count(*) AS n_vertices, sum(ux * vy - vx * uy) * 0.5 AS area FROM half GROUP BY face)"
)


def _half(i):
    return keep(faces.half_edges(i.nodes, i.edges), "half")


@query(with_inputs(FACES + " SELECT face, n_vertices, area FROM fa", "edges"))
def face_areas(i):
    return faces.face_areas(_half(i))


@query(with_inputs(FACES + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_faces, CAST(sum(CASE WHEN area < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_outer, sum(area) AS area_sum FROM fa", "edges"))
def face_count_euler(i):
    a = faces.face_areas(_half(i)).agg(F.count("*").alias("n_faces"), F.sum(F.when(F.col("area") < 0, 1).otherwise(0)).alias("n_outer"), F.sum("area").alias("area_sum"))
    return i.nodes.agg(F.count("*").alias("n_nodes")).join(i.edges.agg(F.count("*").alias("n_edges"))).join(a)


@query(with_inputs(FACES + " SELECT DISTINCT a.face AS f1, b.face AS f2 FROM half a JOIN half b ON a.u = b.v AND a.v = b.u WHERE a.face < b.face AND a.face IN (SELECT face FROM fa WHERE area > 0) AND b.face IN (SELECT face FROM fa WHERE area > 0)", "edges"))
def face_adjacency(i):
    h = _half(i)
    return faces.face_adjacency(h, faces.face_areas(h).filter("area > 0"))


def _moved_half(i):
    h = _half(i)
    at = lambda e: i.moved.select(F.col("node_id").alias(e), F.col("x").alias(e + "x"), F.col("y").alias(e + "y"))
    return h, h.select("face", "u", "v").join(at("u"), "u").join(at("v"), "v")


@query(with_inputs(FACES + ", g AS (SELECT face, abs(sum(a.x * b.y - b.x * a.y) * 0.5) AS area FROM half JOIN moved a ON a.node_id = u JOIN moved b ON b.node_id = v GROUP BY face), r AS (SELECT abs(g.area - abs(fa.area)) / greatest(abs(fa.area), 1e-15) AS r FROM fa JOIN g USING (face) WHERE fa.area > 0) SELECT count(*) AS n_faces, round(quantile_cont(r, 0.5), 6) AS area_median_rel_error, round(max(r), 6) AS area_max_rel_error, round(quantile_cont(r, 0.95), 6) AS area_p95_rel_error, quantile_cont(r, 0.5) <= 0.05 AS area_within_tol FROM r", "edges", "moved"))
def area_metrics(i):
    h, g = _moved_half(i)
    return faces.area_residuals(faces.face_areas(h).filter("area > 0"), faces.face_areas(g))


@query()
def topology_check(i):
    return verify.topology(i.nodes, i.edges, i.nodes, i.edges.filter("v - u <> 41"))


NEAR = "near AS (SELECT point_id, arg_min(node_id, ((x - px) * (x - px) + (y - py) * (y - py), node_id)) AS node_id, min((x - px) * (x - px) + (y - py) * (y - py)) AS d2 FROM {points}, nodes GROUP BY point_id)"


@query(with_inputs(NEAR.format(points="points") + " SELECT point_id, node_id, round(sqrt(d2) * 111000, 1) AS snap_dist_m, sqrt(d2) * 111000 > 50000 AS beyond_tolerance FROM near", "points", "nodes"))
def snap_points(i):
    return overlay.snap(i.points, i.nodes, 1.0, 50_000.0).select("point_id", "node_id", "snap_dist_m", "beyond_tolerance")


@query(with_inputs(NEAR.format(points="points") + " SELECT segment AS layer, count(*) AS points, CAST(sum(CASE WHEN sqrt(d2) * 111000 > 50000 THEN 1 ELSE 0 END) AS BIGINT) AS beyond FROM near JOIN points USING (point_id) GROUP BY segment", "points", "nodes"))
def layer_counts(i):
    s = overlay.snap(i.points, i.nodes, 1.0, 50_000.0).join(i.points.select("point_id", "segment"), "point_id")
    return s.groupBy(F.col("segment").alias("layer")).agg(F.count("*").alias("points"), F.sum(F.col("beyond_tolerance").cast("long")).alias("beyond"))


SNAPL = "pts AS (SELECT DISTINCT x1 AS px, y1 AS py FROM lines UNION SELECT x2, y2 FROM lines), near AS (SELECT px, py, arg_min(node_id, ((x - px) * (x - px) + (y - py) * (y - py), node_id)) AS node_id FROM pts, nodes GROUP BY px, py)"


@query(with_inputs(SNAPL + ", s AS (SELECT line_id, least(a.node_id, b.node_id) AS su, greatest(a.node_id, b.node_id) AS sv FROM lines JOIN near a ON a.px = x1 AND a.py = y1 JOIN near b ON b.px = x2 AND b.py = y2) SELECT line_id, su, sv, edges.u IS NULL AS orphan FROM s LEFT JOIN edges ON su = u AND sv = v", "lines", "edges"))
def snap_lines(i):
    return overlay.snap_lines(i.lines, i.nodes, i.edges, 1.0)


NEXT = "nx AS (SELECT a.poly_id, a.pos, a.x, a.y, b.x AS x2, b.y AS y2 FROM rings a JOIN rings b ON b.poly_id = a.poly_id AND b.pos = (a.pos + 1) % 64)"


@query(with_inputs(
    NEXT + " SELECT poly_id, count(*) AS n_vertices, round(round(abs(sum(x * y2 - x2 * y)) * 0.5 * 111000 * 111000, 1) / 1000000, 3) AS area_km2"
    ", round(sum((x + x2) * (x * y2 - x2 * y)) / (sum(x * y2 - x2 * y) * 3), 6) AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / (sum(x * y2 - x2 * y) * 3), 6) AS cy FROM nx GROUP BY poly_id", "rings"))
def polygon_store(i):
    return overlay.polygon_store(i.rings).select("poly_id", "n_vertices", F.round(F.col("area_m2") / 1_000_000, 3).alias("area_km2"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


DFT = "sp AS (SELECT poly_id, k, sum(x * cos(-2 * pi() * ((k * pos) % 64) / 64) - y * sin(-2 * pi() * ((k * pos) % 64) / 64)) AS re, sum(x * sin(-2 * pi() * ((k * pos) % 64) / 64) + y * cos(-2 * pi() * ((k * pos) % 64) / 64)) AS im FROM rings, range(64) t(k) GROUP BY poly_id, k)"


@query(with_inputs(DFT + " SELECT poly_id, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM sp", "rings"))
def fourier_descriptors(i):
    return spectral.descriptors(i.rings).select("poly_id", F.col("k").cast("long").alias("k"), (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


PHASE = f"CASE WHEN k >= 3 THEN 2 * pi() * {unit('d', 0)} ELSE 0 END"
PERT = DFT + f", ph AS (SELECT *, {PHASE} AS p FROM (SELECT *, {mac(be('poly_id') + ' || ' + be('greatest(k - 3, 0)'))} AS d FROM sp) q), pt AS (SELECT poly_id, k, re * cos(p) - im * sin(p) AS re, re * sin(p) + im * cos(p) AS im FROM ph), inv AS (SELECT poly_id, pos, sum(re * cos(2 * pi() * ((k * pos) % 64) / 64) - im * sin(2 * pi() * ((k * pos) % 64) / 64)) / 64 AS x, sum(re * sin(2 * pi() * ((k * pos) % 64) / 64) + im * cos(2 * pi() * ((k * pos) % 64) / 64)) / 64 AS y FROM pt, range(64) t(pos) GROUP BY poly_id, pos)"


@query(with_inputs(PERT + " SELECT poly_id, pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM inv", "rings"))
def perturb_boundary(i):
    p = spectral.inverse(spectral.perturb(spectral.descriptors(i.rings), KEY))
    return p.select("poly_id", "pos", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(with_inputs(
    PERT + ", nxi AS (SELECT a.poly_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM inv a JOIN inv b ON b.poly_id = a.poly_id AND b.pos = (a.pos + 1) % 64)"
    ", ai AS (SELECT poly_id, abs(sum(x * y2 - x2 * y)) * 0.5 AS area, avg(x) AS cx, avg(y) AS cy FROM nxi GROUP BY poly_id), "
    + NEXT + ", ar AS (SELECT poly_id, abs(sum(x * y2 - x2 * y)) * 0.5 AS area FROM nx GROUP BY poly_id)"
    " SELECT poly_id, pos, round(cx + (x - cx) * sqrt(ar.area / ai.area), 5) + 0.0 AS x, round(cy + (y - cy) * sqrt(ar.area / ai.area), 5) + 0.0 AS y FROM inv JOIN ai USING (poly_id) JOIN ar USING (poly_id)", "rings"))
def match_area(i):
    p = spectral.inverse(spectral.perturb(spectral.descriptors(i.rings), KEY))
    return spectral.match_area(p, spectral.ring_areas(i.rings)).select("poly_id", "pos", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query(with_inputs(NEXT + ", seg AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM nx), cum AS (SELECT *, sum(d) OVER (PARTITION BY poly_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hi FROM seg), tg AS (SELECT poly_id, i, i * max(hi) / 16 AS t FROM cum, range(16) r(i) GROUP BY poly_id, i) SELECT poly_id, i, round(arg_min(x + (t - (hi - d)) / d * (x2 - x), pos), 6) + 0.0 AS x, round(arg_min(y + (t - (hi - d)) / d * (y2 - y), pos), 6) + 0.0 AS y FROM tg JOIN cum USING (poly_id) WHERE hi - d <= t AND t < hi GROUP BY poly_id, i", "rings"))
def resample_boundary(i):
    return boundary.resample(i.rings, 16).select("poly_id", "i", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(with_inputs("bx AS (SELECT min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM nodes), sc AS (SELECT *, least(10 / greatest(e - w, 1e-12), 20 / greatest(n - s, 1e-12)) AS k FROM bx) SELECT node_id, round((x - (w + e) / 2) * k + 5, 6) AS x, round((y - (s + n) / 2) * k + 10, 6) AS y FROM nodes, sc", "nodes"))
def rescale_bbox(i):
    like = i.spark.createDataFrame([(0.0, 0.0), (10.0, 20.0)], "x double, y double")
    return boundary.rescale(i.nodes, like).select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


DEM = "dem AS MATERIALIZED (SELECT id // 64 AS \"row\", id % 64 AS col, sum(z / ((id % 64 - x) * (id % 64 - x) + (id // 64 - y) * (id // 64 - y) + 1e-9)) / sum(1 / ((id % 64 - x) * (id % 64 - x) + (id // 64 - y) * (id // 64 - y) + 1e-9)) AS z FROM range(4096) t(id), (SELECT x, y, CASE WHEN ele > 0 THEN ele ELSE 300 END AS z FROM peaks) p GROUP BY id)"


def _dem(i):
    return raster.idw(i.spark, i.peaks, 64, 64)


@query(with_inputs(DEM + ' SELECT "row", col, round(z, 4) AS z FROM dem', "peaks"))
def dem_idw(i):
    return _dem(i).select("row", "col", F.round("z", 4).alias("z"))


MASK = DEM + ', mask AS MATERIALIZED (SELECT "row", col, z FROM dem WHERE z >= (SELECT quantile_cont(z, 0.6) FROM dem))'


@query(with_inputs(MASK + ' SELECT "row", col FROM mask', "peaks"))
def dem_quantile_mask(i):
    return raster.quantile_mask(_dem(i), 0.6).select("row", "col")


@query(with_inputs(MASK + ", er AS (SELECT m.\"row\" + i AS \"row\", m.col + j AS col FROM mask m, range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) <= 2) SELECT \"row\", col FROM er GROUP BY \"row\", col HAVING count(*) = 13", "peaks"))
def erode_mask(i):
    return raster.erode(raster.quantile_mask(_dem(i), 0.6), 2)


@query(with_inputs(MASK + ', reach AS (SELECT "row", col, "row" * 2147483648 + col AS c FROM mask UNION SELECT m."row", m.col, r.c FROM reach r JOIN mask m ON abs(m."row" - r."row") + abs(m.col - r.col) = 1 WHERE r.c < m."row" * 2147483648 + m.col) SELECT "row", col, min(c) AS region FROM reach GROUP BY "row", col', "peaks", recursive=True))
def pixel_components(i):
    return raster.regions(raster.quantile_mask(_dem(i), 0.6))


@query(with_inputs(DEM + ", q AS (SELECT quantile_cont(z, 0.88) AS hi, quantile_cont(z, 0.2) AS lo, quantile_cont(z, 0.6) AS mid FROM dem) SELECT \"row\", col, CASE WHEN z >= hi THEN 'mountain' WHEN z <= lo THEN 'coast' ELSE 'valley' END AS species FROM dem, q WHERE z >= hi OR z <= mid", "peaks"))
def habitat_priority(i):
    return raster.habitats(_dem(i))


@query(with_inputs("SELECT node_id, round(1e-4 * 111132.0 * 111320.0 * cos(radians(y)), 3) AS area_m2 FROM nodes", "nodes"))
def geodetic_areas(i):
    return i.nodes.select("node_id", F.round(geodetic_area(F.lit(1e-4), F.col("y")), 3).alias("area_m2"))


@query(with_inputs("SELECT u, v, round(2 * 6371000 * asin(least(1, sqrt(sin(radians(b.y - a.y) / 2) * sin(radians(b.y - a.y) / 2) + cos(radians(a.y)) * cos(radians(b.y)) * sin(radians(b.x - a.x) / 2) * sin(radians(b.x - a.x) / 2)))), 3) AS metres FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v", "edges"))
def haversine_lengths(i):
    e = graph.with_ends(i.edges, i.nodes)
    return e.select("u", "v", F.round(haversine(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")), 3).alias("metres"))


PAIRS = f"pairs AS (SELECT a.station_id AS a, b.station_id AS b, {LEN} AS length FROM stations a JOIN stations b ON a.station_id < b.station_id)"


#: An edge is in the tree exactly if no path of strictly smaller edges joins its ends.
@query(with_inputs(PAIRS + ", rk AS (SELECT a, b, length, row_number() OVER (ORDER BY length, a, b) AS r FROM pairs), bi AS (SELECT a, b, r FROM rk UNION ALL SELECT b, a, r FROM rk), reach AS (SELECT r AS edge, a AS n FROM rk UNION SELECT reach.edge, bi.b FROM reach JOIN bi ON bi.a = reach.n AND bi.r < reach.edge) SELECT a, b, length FROM rk WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.edge = rk.r AND reach.n = rk.b)", "stations", recursive=True))
def mst_edges(i):
    s = i.stations
    return network.spanning_tree(s.select(F.col("station_id").alias("node_id")), network.connecting_pairs(s))


CURVES = "SELECT node_id AS edge_id, x AS ax, y AS ay, x + CAST(0.5 AS DOUBLE) AS cx, y + CAST(0.25 AS DOUBLE) AS cy, x + CAST(1 AS DOUBLE) AS bx, y AS \"by\" FROM nodes"


@query(with_inputs(f"cv AS ({CURVES}) SELECT edge_id, i, round((1 - i / 31.0::DOUBLE) * (1 - i / 31.0::DOUBLE) * ax + 2 * (1 - i / 31.0::DOUBLE) * (i / 31.0::DOUBLE) * cx + (i / 31.0::DOUBLE) * (i / 31.0::DOUBLE) * bx, 6) AS x, round((1 - i / 31.0::DOUBLE) * (1 - i / 31.0::DOUBLE) * ay + 2 * (1 - i / 31.0::DOUBLE) * (i / 31.0::DOUBLE) * cy + (i / 31.0::DOUBLE) * (i / 31.0::DOUBLE) * \"by\", 6) AS y FROM cv, range(32) t(i)", "nodes"))
def bezier_points(i):
    e = i.sql(CURVES.replace('"by"', "`by`").replace("FROM nodes", "FROM {nodes}"), nodes=i.nodes)
    return network.bezier_points(e).select("edge_id", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_inputs("SELECT node_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || printf('%.10f', x) || ',' || printf('%.10f', y) || ']},\"properties\":{\"node_id\":' || CAST(node_id AS VARCHAR) || '}}' AS feature FROM nodes", "nodes"))
def geojson_features(i):
    return geojson.point_features(i.nodes)


PAGE = "b AS (SELECT min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM nodes), pg AS (SELECT node_id, printf('%.1f', 40 + (x - w) / (e - w) * 720) AS px, printf('%.1f', 40 + (y - s) / (n - s) * 520) AS py FROM nodes, b)"


@query(with_inputs(PAGE + """ SELECT u, v, '<line x1="' || a.px || '" y1="' || a.py || '" x2="' || b.px || '" y2="' || b.py || '"/>' AS element FROM edges JOIN pg a ON a.node_id = u JOIN pg b ON b.node_id = v""", "edges"))
def svg_elements(i):
    return svg.svg_lines(graph.with_ends(i.edges, i.nodes), i.nodes)


@query()
def tube_lines(i):
    return network.tube_network(i.spark, i.stations, KEY)


@query()
def tutte_embed(i):
    return reembed.reembed(i.nodes, i.edges, tutte_only=True)


@query()
def reembed_graph(i):
    return reembed.reembed(i.nodes, i.edges)
