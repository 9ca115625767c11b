"""Registered queries on labelled graphs, project layers, terrain and networks, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, labelled, network, terrain
from ..operators import layers as project
from ..operators.iterate import keep
from ..sources import geojson, layerfile, svg
from . import catalog
from .catalog import KEY, PAIRS, WL, be, mac, query, unit
from .inputs import with_inputs

#: A pre-built graph with gaps: half of the nodes have lon and lat only, a third of the edges no length, ids are spread out.
GAPS = "SELECT 10 * node_id + 3 AS node_id, CASE WHEN node_id % 2 = 0 THEN x END AS x, CASE WHEN node_id % 2 = 0 THEN y END AS y, x AS lon, y AS lat, brand FROM {nodes}"
GAP_EDGES = "SELECT 10 * v + 3 AS u, 10 * u + 3 AS v, CASE WHEN (u + v) % 3 > 0 THEN CAST(u AS DOUBLE) END AS length, road_class FROM {edges}"


def _gaps(i):
    return labelled.Simple(i.sql(GAPS, nodes=i.nodes), i.sql(GAP_EDGES, edges=i.edges))


@query(with_inputs(
    """rk AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS r FROM nodes)
    SELECT ra.r AS u, rb.r AS v, CASE WHEN (u + v) % 3 > 0 THEN CAST(u AS DOUBLE) ELSE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) END AS length, road_class
    FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v JOIN rk ra ON ra.node_id = u JOIN rk rb ON rb.node_id = v""", "edges"))
def labelled_edges(i):
    return labelled.to_labelled(_gaps(i)).edges.select("u", "v", "length", "road_class")


@query(with_inputs("SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, 10 * node_id + 3 AS original_id, x, y, brand FROM nodes", "nodes"))
def labelled_nodes(i):
    return labelled.to_labelled(_gaps(i)).nodes.select("node_id", "original_id", "x", "y", "brand")


#: Lines with a vertex beside their middle.
BENT = """l AS (SELECT line_id, x1, y1, x2, y2, (x1 + x2) / 2 + 0.125::DOUBLE AS mx, (y1 + y2) / 2 AS my FROM lines),
ends AS (SELECT x1 AS x, y1 AS y, 2 * line_id AS s FROM l UNION ALL SELECT x2, y2, 2 * line_id + 1 FROM l), nd AS (SELECT x, y, row_number() OVER (ORDER BY min(s)) - 1 AS node_id FROM ends GROUP BY x, y),
e AS (SELECT line_id, least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v, sqrt((mx - x1) * (mx - x1) + (my - y1) * (my - y1)) + sqrt((x2 - mx) * (x2 - mx) + (y2 - my) * (y2 - my)) AS length
 FROM l JOIN nd a ON a.x = x1 AND a.y = y1 JOIN nd b ON b.x = x2 AND b.y = y2 WHERE a.node_id <> b.node_id)"""


@query(with_inputs(BENT + " SELECT u, v, round(arg_min(length, line_id), 9) AS length, arg_min('L' || CAST(line_id AS VARCHAR), line_id) AS label FROM e GROUP BY u, v", "lines"))
def labelled_lines(i):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    path = F.array(p(F.col("x1"), F.col("y1")), p((F.col("x1") + F.col("x2")) / 2 + 0.125, (F.col("y1") + F.col("y2")) / 2), p(F.col("x2"), F.col("y2")))
    g = labelled.to_labelled(i.lines.select("line_id", path.alias("path"), F.concat(F.lit("L"), F.col("line_id").cast("string")).alias("label")))
    return g.edges.select("u", "v", F.round("length", 9).alias("length"), "label")


def _lattice(i):
    return labelled.Labelled(i.nodes.select("node_id", "x", "y", "brand", "size"), i.edges.withColumn("length", F.lit(1.0)), {"source": "lattice", "crs": labelled.CRS})


@query(with_inputs(
    """c AS (SELECT road_class, count(*) AS n FROM edges GROUP BY road_class)
    SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, string_agg(road_class || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY road_class) AS classes FROM c""", "edges"))
def labelled_facts(i):
    return labelled.facts(_lattice(i)).select("n_nodes", "n_edges", "classes")


@query(with_inputs(
    WL + f""", gh AS (SELECT sha256(string_agg(t, ',' ORDER BY t)) AS graph_hash FROM (SELECT label || ':' || CAST(count(*) AS VARCHAR) AS t FROM l5 GROUP BY label) q),
    el AS (SELECT 'n' || CAST(node_id AS VARCHAR) AS k, '{{"brand":"' || brand || '","size":' || CAST(size AS VARCHAR) || '}}' AS j FROM nodes
     UNION ALL SELECT 'e' || CAST(u AS VARCHAR) || '-' || CAST(v AS VARCHAR), '{{"road_class":"' || road_class || '"}}' FROM edges),
    parts AS (SELECT p || sha256(string_agg(h, '' ORDER BY h)) AS t FROM (SELECT h, substr(h, 1, 2) AS p FROM (SELECT sha256(k || '=' || j) AS h FROM el) q) q2 GROUP BY p),
    ah AS (SELECT sha256(string_agg(t, '' ORDER BY t)) AS attribute_hash FROM parts)
    SELECT graph_hash, attribute_hash, {mac("encode(graph_hash || '|' || attribute_hash)")} AS checksum FROM gh, ah""", "edges"))
def graph_checksum(i):
    g = labelled.Labelled(i.nodes.select("node_id", "brand", "size"), i.edges)
    return labelled.checksum(g, KEY)


#: One feature a customer: every kind of geometry in turn.
FEATURES = """SELECT point_id AS feature_id, CASE point_id % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'LineString' WHEN 3 THEN 'MultiLineString' WHEN 4 THEN 'Polygon' ELSE 'GeometryCollection' END AS type,
 CASE point_id % 6 WHEN 0 THEN concat('[', px, ',', py, ']') WHEN 1 THEN concat('[[', px, ',', py, '],[', px + 1, ',', py, ']]') WHEN 2 THEN concat('[[', px, ',', py, '],[', px, ',', py + 1, '],[', px + 1, ',', py + 1, ']]')
  WHEN 3 THEN concat('[[[', px, ',', py, '],[', px + 1, ',', py, ']],[[', px, ',', py, '],[', px, ',', py + 1, ']]]')
  WHEN 4 THEN concat('[[[', px, ',', py, '],[', px + 1, ',', py, '],[', px + 1, ',', py + 1, '],[', px, ',', py + 1, '],[', px, ',', py, ']],[[', px + 0.25D, ',', py + 0.25D, '],[', px + 0.25D, ',', py + 0.75D, '],[', px + 0.75D, ',', py + 0.75D, '],[', px + 0.75D, ',', py + 0.25D, '],[', px + 0.25D, ',', py + 0.25D, ']]]') END AS coordinates,
 CASE WHEN point_id % 6 = 5 THEN concat('[{{"type":"Point","coordinates":[', px, ',', py, ']}},{{"type":"LineString","coordinates":[[', px, ',', py, '],[', px + 1, ',', py + 1, ']]}}]') END AS geometries,
 map('segment', segment) AS attrs FROM {points}"""
PART_POINTS = "pp AS (SELECT point_id AS fid, CAST(point_id AS VARCHAR) || CASE point_id % 6 WHEN 0 THEN '' ELSE '.0' END AS part_id, px, py FROM points WHERE point_id % 6 IN (0, 1, 5) UNION ALL SELECT point_id, CAST(point_id AS VARCHAR) || '.1', px + 1, py FROM points WHERE point_id % 6 = 1)"
PART_LINES = """pl AS (SELECT CAST(point_id AS VARCHAR) || CASE point_id % 6 WHEN 2 THEN '' ELSE '.1' END AS part_id, px AS x1, py AS y1, px + 1 AS x2, py + 1 AS y2 FROM points WHERE point_id % 6 IN (2, 5)
 UNION ALL SELECT CAST(point_id AS VARCHAR) || '.0', px, py, px + 1, py FROM points WHERE point_id % 6 = 3 UNION ALL SELECT CAST(point_id AS VARCHAR) || '.1', px, py, px, py + 1 FROM points WHERE point_id % 6 = 3)"""
NEAREST = "(SELECT {p}, arg_min(node_id, ((x - {a}) * (x - {a}) + (y - {b}) * (y - {b}), node_id)) AS node_id, min((x - {a}) * (x - {a}) + (y - {b}) * (y - {b})) AS d2 FROM {t}, nodes GROUP BY {p})"


def _project(i):
    p = project.Project(labelled.Labelled(i.nodes, i.edges), 1.0)
    p.add_layer(i.sql(FEATURES, points=i.points), "customers", 50_000.0)
    return p


@query(with_inputs(PART_POINTS + ", near AS " + NEAREST.format(p="part_id", a="px", b="py", t="pp") + " SELECT part_id, node_id, round(sqrt(d2) * 111000, 1) AS snap_dist_m, sqrt(d2) * 111000 > 50000 AS beyond_tolerance, segment FROM near JOIN pp USING (part_id) JOIN points ON point_id = fid", "points", "nodes"))
def layer_points(i):
    return _project(i).get_points("customers").select("part_id", "node_id", "snap_dist_m", "beyond_tolerance", F.col("attrs")["segment"].alias("segment"))


@query(with_inputs(
    PART_LINES + ", s AS " + NEAREST.format(p="part_id", a="x1", b="y1", t="pl") + ", t AS " + NEAREST.format(p="part_id", a="x2", b="y2", t="pl")
    + ", j AS (SELECT part_id, least(s.node_id, t.node_id) AS su, greatest(s.node_id, t.node_id) AS sv FROM s JOIN t USING (part_id)) SELECT part_id, su, sv, e.u IS NULL AS orphan FROM j LEFT JOIN edges e ON e.u = su AND e.v = sv", "points", "edges"))
def layer_lines(i):
    return _project(i).get_lines().select("part_id", "su", "sv", "orphan")


@query(with_inputs("SELECT CAST(point_id AS VARCHAR) AS part_id, CAST(9240750000 AS DOUBLE) AS area_m2, round(px + 0.5, 6) AS cx, round(py + 0.5, 6) AS cy FROM points WHERE point_id % 6 = 4", "points"))
def layer_polygons(i):
    return _project(i).get_polygons().select("part_id", "area_m2", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(with_inputs(
    PART_POINTS + ", " + PART_LINES + ", near AS " + NEAREST.format(p="part_id", a="px", b="py", t="pp")
    + " SELECT (SELECT count(*) FROM pp) AS points, (SELECT count(*) FROM pl) AS lines, (SELECT count(*) FROM points WHERE point_id % 6 = 4) AS polygons, CAST(sum(CASE WHEN sqrt(d2) * 111000 > 50000 THEN 1 ELSE 0 END) AS BIGINT) AS beyond_tolerance FROM near", "points", "nodes"))
def layer_meta(i):
    p = _project(i)
    c = p.get_layers()["customers"]
    return i.spark.createDataFrame([tuple(c[k] for k in ("points", "lines", "polygons", "beyond_tolerance"))], "points long, lines long, polygons long, beyond_tolerance long")


#: Tags from the parts' sizes and types, by which a sheet's layers are told.
TAGS = """SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'building' WHEN 1 THEN 'natural' WHEN 2 THEN 'landuse' WHEN 3 THEN 'waterway' WHEN 4 THEN 'place' ELSE 'natural' END AS k,
 CASE p_size % 7 WHEN 1 THEN 'coastline' WHEN 4 THEN CASE WHEN p_size > 20 THEN 'town' ELSE 'city' END WHEN 5 THEN 'peak' WHEN 6 THEN CASE WHEN p_size > 20 THEN 'water' ELSE 'wood' END ELSE 'yes' END AS v FROM {part}"""


@query(f"""WITH t AS ({TAGS.format(part='part')}), l AS (SELECT unnest(['buildings', 'coastline', 'landuse', 'water', 'settlements', 'peaks']) AS layer)
SELECT layer, CAST(sum(CASE WHEN (layer = 'buildings' AND k = 'building') OR (layer = 'coastline' AND k = 'natural' AND v = 'coastline') OR (layer = 'landuse' AND (k = 'landuse' OR k = 'natural' AND v IN ('wood', 'scrub', 'grassland', 'bare_rock')))
 OR (layer = 'water' AND (k = 'waterway' OR k = 'natural' AND v = 'water')) OR (layer = 'settlements' AND k = 'place' AND v IN ('town', 'village', 'hamlet', 'suburb')) OR (layer = 'peaks' AND k = 'natural' AND v = 'peak') THEN 1 ELSE 0 END) AS BIGINT) AS n FROM t, l GROUP BY layer""")
def tagged_layers(i):
    t = i.sql(TAGS, part=i.table("part"))
    return layerfile.layer_counts(t.select(F.col("id").alias("feature_id"), F.create_map("k", "v").alias("attrs")))


OUT = catalog.MASK + """, sides AS (SELECT m."row", m.col FROM mask m, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(i, j) WHERE NOT EXISTS (SELECT 1 FROM mask n WHERE n."row" = m."row" + d.i AND n.col = m.col + d.j)),
reach AS (SELECT "row", col, "row" * 2147483648 + col AS c FROM mask UNION SELECT m."row", m.col, r.c FROM reach r JOIN mask m ON abs(m."row" - r."row") + abs(m.col - r.col) = 1 WHERE r.c < m."row" * 2147483648 + m.col),
reg AS (SELECT "row", col, min(c) AS region FROM reach GROUP BY "row", col)"""


@query(with_inputs(OUT + ' SELECT region, CAST(any_value(p.n) AS BIGINT) AS perimeter, CAST(count(*) AS DOUBLE) AS area FROM reg JOIN (SELECT region, count(*) AS n FROM sides JOIN reg USING ("row", col) GROUP BY region) p USING (region) GROUP BY region', "peaks", recursive=True))
def mask_outlines(i):
    return terrain.region_outlines(terrain.quantile_mask(catalog._dem(i), 0.6)).select("region", "perimeter", "area")


@query(with_inputs(
    """g AS (SELECT k, exp(-0.5 * (k / 1.5::DOUBLE) * (k / 1.5::DOUBLE)) AS w FROM range(-6, 7) t(k)), s AS (SELECT sum(w) AS total FROM g)
    SELECT poly_id, (pos + k + 64) % 64 AS pos, round(sum(x * w / total), 6) + 0.0 AS x, round(sum(y * w / total), 6) + 0.0 AS y FROM rings, g, s GROUP BY 1, 2""", "rings"))
def smooth_rings(i):
    return terrain.smooth(i.rings, 1.5).select("poly_id", "pos", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(with_inputs(
    """q AS (SELECT node_id, radians(y) AS p, radians(x - 20) AS d, radians(23::DOUBLE) AS p0 FROM nodes), c AS (SELECT *, acos(greatest(-1, least(1, sin(p0) * sin(p) + cos(p0) * cos(p) * cos(d)))) AS c FROM q WHERE abs(p) < 1.5),
    k AS (SELECT *, CASE WHEN sin(c) = 0 THEN 1 ELSE c / sin(c) END * 6371000 AS k FROM c) SELECT node_id, round(k * cos(p) * sin(d), 2) + 0.0 AS mx, round(k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(d)), 2) + 0.0 AS my, true AS back FROM k""", "nodes"))
def projected_nodes(i):
    m = i.nodes.filter(F.abs(F.radians("y")) < 1.5).select("node_id", "x", "y", terrain.to_metres(F.col("x"), F.col("y"), 20.0, 23.0).alias("m"))
    m = m.withColumn("b", terrain.to_degrees(F.col("m.x"), F.col("m.y"), 20.0, 23.0))
    same = (F.abs(F.col("b.lat") - F.col("y")) < 1e-6) & (F.abs(F.col("b.lon") - F.col("x")) < 1e-6)
    return m.select("node_id", (F.round("m.x", 2) + 0.0).alias("mx"), (F.round("m.y", 2) + 0.0).alias("my"), same.alias("back"))


@query(with_inputs("SELECT least((SELECT min(x) FROM nodes), (SELECT min(px) FROM points)) AS west, least((SELECT min(y) FROM nodes), (SELECT min(py) FROM points)) AS south, greatest((SELECT max(x) FROM nodes), (SELECT max(px) FROM points)) AS east, greatest((SELECT max(y) FROM nodes), (SELECT max(py) FROM points)) AS north", "nodes", "points"))
def map_extent(i):
    return terrain.extent(i.nodes, i.points.select(F.col("px").alias("x"), F.col("py").alias("y")))


@query()
def map_hull(i):
    return terrain.hull(i.nodes)


#: Settlements and roads on the sheet of 64 x 64 pixels.
TOWNS = "SELECT CAST((s_suppkey * 11) % 64 AS DOUBLE) AS x, CAST((s_suppkey * 29) % 64 AS DOUBLE) + 0.25D AS y FROM {supplier} WHERE s_acctbal < 0"
ROADS = "SELECT CAST(n_nationkey * 2 AS DOUBLE) AS x1, 3D AS y1, CAST(n_regionkey * 12 AS DOUBLE) AS x2, 61D AS y2 FROM {nation}"


@query(with_inputs(catalog.DEM + ", t AS (" + TOWNS.format(supplier="supplier").replace("D AS y", "::DOUBLE AS y") + ') SELECT DISTINCT "row", col FROM dem, t WHERE (col + 0.5 - t.x) * (col + 0.5 - t.x) + ("row" + 0.5 - t.y) * ("row" + 0.5 - t.y) <= 6.25', "peaks"))
def pixels_near_towns(i):
    return terrain.near_points(catalog._dem(i), i.sql(TOWNS, supplier=i.table("supplier")), 2.5)


@query(with_inputs(
    catalog.DEM + ", s AS (" + ROADS.format(nation="nation").replace("3D", "3::DOUBLE").replace("61D", "61::DOUBLE") + """), q AS (SELECT "row", col, col + 0.5 - x1 AS px, "row" + 0.5 - y1 AS py, x2 - x1 AS dx, y2 - y1 AS dy FROM dem, s),
    t AS (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM q) SELECT DISTINCT "row", col FROM t WHERE (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= 1.7""", "peaks"))
def pixels_near_roads(i):
    return terrain.near_segments(catalog._dem(i), i.sql(ROADS, nation=i.table("nation")), 1.7**0.5)


@query()
def habitat_layers(i):
    return terrain.habitats(catalog._dem(i), i.sql(TOWNS, supplier=i.table("supplier")), i.sql(ROADS, nation=i.table("nation")), land_z=1000.0)


@query(with_inputs(PAIRS + " SELECT a, b, length FROM pairs WHERE length <= 0.75", "stations"))
def station_neighbours(i):
    return network.near_pairs(i.stations, 0.75)


ENDS = "SELECT u * 100000 + v AS edge_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\" FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v"


@query(with_inputs(
    f"""en AS ({ENDS}), d AS (SELECT *, {mac(be('edge_id'))} AS d FROM en), k AS (SELECT *, 0.15 * (1 + 0.3 * sqrt(-2 * ln(greatest({unit('d', 0)}, 1e-300))) * cos(2 * pi() * {unit('d', 8)})) * CASE WHEN {unit('d', 16)} > 0.5 THEN 1 ELSE -1 END AS k FROM d)
    SELECT edge_id, round((ax + bx) / 2 - k * ("by" - ay), 6) + 0.0 AS cx, round((ay + "by") / 2 + k * (bx - ax), 6) + 0.0 AS cy FROM k""", "edges"))
def curve_controls(i):
    e = graph.with_ends(i.edges, i.nodes).select((F.col("u") * 100000 + F.col("v")).alias("edge_id"), F.col("ux").alias("ax"), F.col("uy").alias("ay"), F.col("vx").alias("bx"), F.col("vy").alias("by"))
    return network.keyed_curves(e, KEY).select("edge_id", (F.round("cx", 6) + 0.0).alias("cx"), (F.round("cy", 6) + 0.0).alias("cy"))


@query(with_inputs(
    """el AS (SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.10f', x) || ',' || printf('%.10f', y) || ']},"properties":{"brand":"' || brand || '","node_id":' || CAST(node_id AS VARCHAR) || ',"size":' || CAST(size AS VARCHAR) || '}}' AS t FROM nodes
    UNION ALL SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || printf('%.10f', a.x) || ',' || printf('%.10f', a.y) || '],[' || printf('%.10f', b.x) || ',' || printf('%.10f', b.y) || ']]},"properties":{"road_class":"' || road_class || '","u":' || CAST(u AS VARCHAR) || ',"v":' || CAST(v AS VARCHAR) || '}}' FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)
    SELECT t AS feature FROM el""", "edges"))
def geojson_collection(i):
    return geojson.features(i.nodes.select("node_id", "x", "y", "brand", "size"), i.edges)


@query(with_inputs(
    """b AS (SELECT min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM nodes), p AS (SELECT node_id, 40 + (x - w) / (e - w) * 720 AS px, 40 + (y - s) / (n - s) * 520 AS py FROM nodes, b)
    SELECT 2 AS layer, CAST(node_id AS VARCHAR) AS id, '<circle cx="' || printf('%.1f', px) || '" cy="' || printf('%.1f', py) || '" r="3" fill="#D55E00"/>' AS element FROM p""", "nodes"))
def svg_nodes(i):
    return svg.page(i.nodes, i.edges).filter("layer = 2").select("layer", "id", "element")
