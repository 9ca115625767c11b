"""Sources, labelled graphs, layers, terrain and networks against brute force on small inputs."""

from __future__ import annotations

import json
import math
import random
import struct
import zlib

import pytest

from geoshroud.functions import keyed
from geoshroud.operators import labelled, layers, network, terrain
from geoshroud.sources import geojson, geotiff, layerfile, svg

KEY = bytes(32)


@pytest.fixture(scope="module")
def square(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, "a"), (1, 1.0, 0.0, "b"), (2, 1.0, 1.0, None), (3, 0.0, 1.0, "d")], "node_id long, x double, y double, name string")
    edges = spark.createDataFrame([(0, 1, 1.0, "track"), (1, 2, 1.0, "track"), (2, 3, 1.0, "primary"), (0, 3, 1.0, None)], "u long, v long, length double, road_class string")
    return labelled.Labelled(nodes, edges, {"source": "test", "crs": labelled.CRS})


def test_labelled_sources(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(5, line((0, 0), (3, 4)), "a"), (6, line((3, 4), (0, 0)), "again"), (7, line((1, 1), (1, 1)), "loop"), (8, line((3, 4), (3, 5), (0, 5)), "bent"), (9, [], "none")]
    g = labelled.to_labelled(spark.createDataFrame(rows, "line_id long, path array<struct<x:double,y:double>>, name string"))
    assert {(r.u, r.v, r.length, r.name) for r in g.edges.collect()} == {(0, 1, 5.0, "a"), (1, 3, 4.0, "bent")}
    assert [tuple(r) for r in g.nodes.orderBy("node_id").select("x", "y").collect()] == [(0, 0), (3, 4), (1, 1), (0, 5)]
    with pytest.raises(ValueError):
        labelled.to_labelled(spark.createDataFrame(rows[2:3], "line_id long, path array<struct<x:double,y:double>>, name string"))
    with pytest.raises(TypeError):
        labelled.to_labelled([1, 2])
    nodes = spark.createDataFrame([(7, 1.0, 2.0), (3, None, 4.0), (5, 5.0, None)], "node_id long, lon double, lat double")
    edges = spark.createDataFrame([(7, 3, 9.0, 1), (3, 7, 2.0, 2), (7, 3, None, 3)], "u long, v long, length double, seq long")
    s = labelled.to_labelled(labelled.Simple(nodes, edges.filter("seq = 3")))
    assert [tuple(r) for r in s.nodes.orderBy("node_id").select("original_id", "x", "y").collect()] == [(3, 0.0, 4.0), (5, 5.0, 0.0), (7, 1.0, 2.0)]
    assert s.edges.first().length == pytest.approx(math.hypot(1, 2))
    m = labelled.to_labelled(labelled.Multi(nodes.withColumnsRenamed({"lon": "x", "lat": "y"}), edges))
    assert [(r.u, r.v, r.length) for r in m.edges.collect()] == [(0, 1, 2.0)] and m.nodes.count() == 2  # nodes without an edge go
    assert labelled.largest(s).nodes.count() == 2


def test_summary_conditions_and_checksum(spark, square):
    text = labelled.summary_text(square, planar=True)
    assert "nodes: 4" in text and "components: 1" in text and "road classes: primary: 1, track: 2, unknown: 1" in text and "planar: True" in text
    labelled.require_connected(square)
    with pytest.raises(ValueError):
        labelled.require_connected(labelled.Labelled(square.nodes, square.edges.limit(1)))
    a, b = (labelled.checksum(g, KEY).first() for g in (square, labelled.Labelled(square.nodes.select("name", "y", "x", "node_id"), square.edges)))
    assert a == b and a.checksum == keyed.checksum(KEY, a.graph_hash, a.attribute_hash)
    other = labelled.checksum(labelled.Labelled(square.nodes.replace("a", "z", "name"), square.edges), KEY).first()
    assert other.graph_hash == a.graph_hash and other.attribute_hash != a.attribute_hash and other.checksum != a.checksum


def test_project_layers(spark, square, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    shapes = [
        {"type": "Point", "coordinates": [0.1, 0.1]}, {"type": "MultiPoint", "coordinates": [[1, 0.9], [9, 9]]}, {"type": "LineString", "coordinates": [[0, 0], [5, 5], [1, 0]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[1, 0], [1, 1]]]}, {"type": "Polygon", "coordinates": [ring, [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 1]}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}]}]}, None,
    ]
    file = tmp_path / "layer.geojson"
    file.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": i, "w": None}, "geometry": s} for i, s in enumerate(shapes)]}))
    p = layers.Project(square, 0.5)
    assert p.summarise() == "No project layers attached."
    assert p.add_layer(file, "one", 100_000.0) == {"points": 5, "lines": 3, "polygons": 3, "total": 11, "beyond_tolerance": 1}
    assert {(r.part_id, r.node_id) for r in p.get_points("one").collect()} == {("0", 0), ("1.0", 2), ("1.1", 2), ("6.0", 3), ("6.1.0", 2)}
    assert {(r.part_id, r.su, r.sv, r.orphan) for r in p.get_lines().collect()} == {("2", 0, 1, False), ("3.0", 0, 2, True), ("3.1", 1, 2, False)}
    poly = {r.part_id: r for r in p.get_polygons().collect()}
    assert poly["4"].area_m2 == pytest.approx(15 * 111_000**2, rel=1e-9) and poly["4"].cx == pytest.approx((32 - 1.5) / 15) and poly["5.1"].cy == pytest.approx(2) and json.loads(poly["5.0"].boundary) == ring
    assert "one: 5 pts, 3 lines, 3 polys (11 total)" in p.summarise() and p.get_points("two") is None
    features = layerfile.read_layer(spark, str(file))
    for bad, why in ((("x.geojson", "two"), FileNotFoundError), ((features, "one"), ValueError), ((features.limit(0), "two"), ValueError), (([], "two"), TypeError)):
        with pytest.raises(why):
            p.add_layer(*bad)
    assert layerfile.read_or_empty(spark, str(tmp_path / "gone.shp"), "gone").count() == 0
    assert layerfile.tagged(features, {"id": ["2", "4"]}).count() == 2 and layerfile.tagged(features, {"w": True}).count() == 0


def shp(kind, bodies):
    recs = b"".join(struct.pack(">ii", i + 1, (4 + len(b)) // 2) + struct.pack("<i", k) + b for i, (k, b) in enumerate(bodies))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(recs)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + recs


def test_shapefile(spark, tmp_path):
    xy = lambda *p: b"".join(struct.pack("<2d", *q) for q in p)
    multi = lambda *parts: struct.pack("<4d2i", 0, 0, 0, 0, len(parts), sum(map(len, parts))) + struct.pack(f"<{len(parts)}i", *[sum(map(len, parts[:i])) for i in range(len(parts))]) + b"".join(xy(*p) for p in parts)
    outer, hole, second = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    (tmp_path / "a.shp").write_bytes(shp(5, [(5, multi(outer, hole)), (0, b""), (5, multi(outer, hole, second)), (3, multi([(0, 0), (1, 1)])), (1, xy((7, 8)))]))
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14)
    rows = [b" first ", b" gone  ", b"*dead  ", b"       ", b" last  "]
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, len(rows), 32 + 32 + 1, 7) + fields + b"\r" + b"".join(rows))
    got = {r.feature_id: r for r in layerfile.read_layer(spark, str(tmp_path / "a.shp")).collect()}
    assert {i: r.type for i, r in got.items()} == {1: "Polygon", 3: "MultiPolygon", 4: "LineString", 5: "Point"}
    assert json.loads(got[1].coordinates) == [[list(p) for p in outer], [list(p) for p in hole]] and len(json.loads(got[3].coordinates)) == 2
    assert got[1].attrs == {"NAME": "first"} and got[3].attrs is None and got[4].attrs == {"NAME": None} and got[5].attrs == {"NAME": "last"}


@pytest.mark.parametrize("packed", [False, True])
def test_geotiff(spark, tmp_path, packed):
    z = [[float(10 * r + c) for c in range(5)] for r in range(6)]
    strips = [b"".join(struct.pack("<5f", *row) for row in z[r : r + 4]) for r in (0, 4)]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    body, at = b"", 8
    places = []
    for s in strips:
        places.append((at + len(body), len(s)))
        body += s
    extra = at + len(body)
    doubles = struct.pack("<3d", 0.5, 0.25, 0) + struct.pack("<6d", 0, 0, 0, 20.0, 40.0, 0)
    lists = struct.pack("<2I", *[p for p, _ in places]) + struct.pack("<2I", *[n for _, n in places])
    tags = [(256, 3, 1, 5), (257, 3, 1, 6), (258, 3, 1, 32), (259, 3, 1, 8 if packed else 1), (273, 4, 2, extra + 72), (277, 3, 1, 1), (278, 3, 1, 4), (279, 4, 2, extra + 80), (339, 3, 1, 3), (33550, 12, 3, extra), (33922, 12, 6, extra + 24)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    (tmp_path / "d.tif").write_bytes(b"II*\0" + struct.pack("<I", extra + len(doubles) + len(lists)) + body + doubles + lists + ifd)
    got = {(r.row, r.col): r for r in geotiff.read_dem(spark, str(tmp_path / "d.tif")).collect()}
    assert {k: r.z for k, r in got.items()} == {(r, c): z[r][c] for r in range(6) for c in range(5)}
    assert (got[5, 4].x, got[5, 4].y) == (20.0 + 4.5 * 0.5, 40.0 - 5.5 * 0.25)
    with pytest.raises(FileNotFoundError):
        geotiff.read_dem(spark, str(tmp_path / "no.tif"))


def test_outlines_and_hull(spark):
    cells = [(r, c) for r in range(4) for c in range(4) if (r, c) not in ((1, 1), (1, 2))] + [(4, 4), (9, 9)]
    mask = spark.createDataFrame(cells, "row long, col long")
    got = {r.region: r for r in terrain.region_outlines(mask).collect()}
    sides = lambda part: sum((r + i, c + j) not in cells for r, c in part for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    main = [p for p in cells if p[0] < 4]
    assert (got[0].n_rings, got[0].perimeter, got[0].area) == (2, sides(main), len(main)) and len(got) == 3
    assert all(r.n_rings == 1 and r.area == 1 for k, r in got.items() if k)
    r = random.Random(1)
    pts = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(200)]
    hull = [(p.x, p.y) for p in terrain.hull(spark.createDataFrame(pts, "x long, y long")).orderBy("pos").collect()]
    for a, b in zip(hull, hull[1:] + hull[:1]):
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in pts)
    assert set(hull) <= {(float(x), float(y)) for x, y in pts} and terrain.hull(spark.createDataFrame([], "x long, y long")).count() == 0


def test_habitats_are_disjoint_and_away(spark):
    dem = spark.range(900).selectExpr("id div 30 AS row", "id % 30 AS col", "greatest(0D, 20 - sqrt(pow(id div 30 - 15, 2) + pow(id % 30 - 15, 2)) * 1.5) AS z")
    towns, roads = spark.createDataFrame([(15.0, 4.0)], "x double, y double"), spark.createDataFrame([(0.0, 20.0, 30.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    got = terrain.habitats(dem, towns, roads).collect()
    assert len({(r.row, r.col) for r in got}) == len(got) and {r.species for r in got} == {"mountain", "coast", "valley"}
    z = {(r.row, r.col): r.z for r in dem.collect()}
    for r in got:
        assert z[r.row, r.col] > 0 and r.n_pixels >= 4 and r.habitat_id[:3] == r.species[:3].upper()
        if r.species != "mountain":
            assert math.hypot(r.col + 0.5 - 15, r.row + 0.5 - 4) > (4 if r.species == "coast" else 2)
        if r.species == "valley":
            assert abs(r.row + 0.5 - 20) > 1


def test_networks(spark):
    r = random.Random(5)
    at = [(i, r.random() * 10, r.random()) for i in range(40)] + [(40, 50.0, 0.0)]
    stations = spark.createDataFrame(at, "station_id long, x double, y double")
    nodes = stations.selectExpr("station_id AS node_id")
    tree = network.spanning_tree(nodes, network.connecting_pairs(stations)).collect()
    d = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), a[0], b[0]) for a in at for b in at if a[0] < b[0])
    root = list(range(41))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = []
    for w, a, b in d:
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b))
    assert sorted((t.a, t.b) for t in tree) == sorted(want)
    rows = network.tube_network(spark, stations, KEY, 2).collect()
    assert len(rows) == 42 and sorted(map(tuple, rows)) == sorted(map(tuple, network.tube_network(spark, stations, KEY, 2).collect()))
    assert len(network.tube_network(spark, stations.limit(1), KEY).collect()) == 0
    by = {}
    for t in rows:
        by.setdefault(t.line_name, []).append((t.station_a, t.station_b))
    for edges in by.values():  # every line is one walk: at most two ends of odd degree
        ends = [x for e in edges for x in e]
        assert sum(ends.count(x) % 2 for x in set(ends)) <= 2


def test_documents(spark, square, tmp_path):
    geojson.write_collection(square.nodes, square.edges, str(tmp_path / "g"), "abc")
    text = "".join(p.read_text() for part in (0, 1, 2) for p in sorted((tmp_path / "g" / f"part={part}").glob("*.txt")))
    doc = json.loads(text)
    assert doc["properties"]["checksum"] == "abc" and sum(f["geometry"] is not None for f in doc["features"]) == 8
    assert {f["properties"].get("road_class") for f in doc["features"]} == {None, "track", "primary"}
    rows = [r.element for r in svg.page(square.nodes, square.edges).orderBy("layer", "id").collect()]
    assert rows[0].startswith("<svg") and rows[-1] == "</svg>" and sum("<line" in x for x in rows) == 4 and sum("<circle" in x for x in rows) == 4
