import numpy as np
import pytest

from geoshroud.operators import canon, faces, graph, overlay, reembed, verify
from geoshroud.operators.iterate import components


def grid(spark, w, h, jitter=0.2):
    rng = np.random.default_rng(1)
    nodes = [(i, float(i % w + rng.uniform(-jitter, jitter)), float(i // w + rng.uniform(-jitter, jitter))) for i in range(w * h)]
    edges = [(i, i + 1) for i in range(w * h) if i % w < w - 1] + [(i, i + w) for i in range(w * (h - 1))]
    return spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame(edges, "u long, v long")


def cycle(spark, ids):
    n = spark.createDataFrame([(i, 0.0, 0.0) for i in ids], "node_id long, x double, y double")
    return n, spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:] + ids[:1])], "u long, v long")


def test_collapse_prefers_the_shortest_then_the_first(spark):
    raw = spark.createDataFrame([(1, 2, 5.0, 1), (2, 1, 3.0, 2), (1, 2, 3.0, 3), (2, 3, None, 4), (4, 4, 1.0, 5)], "u long, v long, length double, seq long")
    got = {(r.u, r.v): (r.length, r.seq, r.parallels) for r in graph.collapse(raw).collect()}
    assert got == {(1, 2): (3.0, 2, 3), (2, 3): (None, 4, 1), (4, 4): (1.0, 5, 1)}


def test_attributes_of_shorter_rows_win(spark):
    raw = spark.createDataFrame([(1, 2, 5.0, 1, {"a": "1", "b": "1"}), (2, 1, 3.0, 2, {"a": "2"}), (1, 2, 3.0, 3, {"a": "3"})], "u long, v long, length double, seq long, attrs map<string,string>")
    r = graph.merge_attributes(raw).first()
    assert r.length == 3.0 and r.attrs == {"a": "2", "b": "1"}


def test_components_of_paths_and_loops(spark):
    n = spark.createDataFrame([(i,) for i in range(40)], "node_id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 25)] + [(30, 30), (35, 34)], "u long, v long")
    got = {r.node_id: r.component for r in components(n, e).collect()}
    assert all(got[i] == 0 for i in range(26)) and got[30] == 30 and got[35] == 34


def test_labels_are_invariant(spark):
    h = [canon.wl_graph_hash(canon.wl_labels(*cycle(spark, ids))).first()[0] for ids in ([0, 1, 2, 3, 4], [9, 3, 7, 1, 5], [0, 1, 2, 3, 4, 5])]
    assert h[0] == h[1] != h[2]


def test_faces_follow_euler(spark):
    n, e = grid(spark, 6, 5)
    a = faces.face_areas(faces.half_edges(n, e)).collect()
    assert len(a) == e.count() - 30 + 2 and sum(r.area < 0 for r in a) == 1 and abs(sum(r.area for r in a)) < 1e-9


def test_reembedding_keeps_lengths_and_areas(spark):
    n, e = grid(spark, 9, 8)
    new = reembed.reembed(n, e)
    rows = new.toPandas().sort_values("node_id")
    again = reembed.reembed(n, e).toPandas().sort_values("node_id")
    assert np.isfinite(rows[["x", "y"]].to_numpy()).all() and np.allclose(rows[["x", "y"]], again[["x", "y"]], atol=1e-10)
    m = verify.length_metrics(verify.length_errors(graph.edge_lengths(e, n), graph.edge_lengths(e, new))).first()
    assert m.length_mean_rel_error < 0.3
    h = faces.half_edges(n, e)
    moved = {r.node_id: (r.x, r.y) for r in rows.itertuples()}
    before = {r.face: r.area for r in faces.face_areas(h).collect() if r.area > 0}
    after = {}
    for r in h.collect():
        (ax, ay), (bx, by) = moved[r.u], moved[r.v]
        after[r.face] = after.get(r.face, 0) + (ax * by - bx * ay) / 2
    assert np.median([abs(abs(after[f]) - a) / a for f, a in before.items()]) < 0.05


def test_snap_is_the_nearest_node(spark):
    n, _ = grid(spark, 6, 5)
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-30, 40, (60, 2)))]
    got = {r.point_id: r.node_id for r in overlay.snap(spark.createDataFrame(pts, "point_id long, px double, py double"), n, 0.5).collect()}
    ns = n.collect()
    assert got == {i: min(ns, key=lambda r: ((r.x - x) ** 2 + (r.y - y) ** 2, r.node_id)).node_id for i, x, y in pts}


def test_topology_of_a_changed_graph(spark):
    n, e = grid(spark, 4, 4)
    r = verify.topology(n, e, n, e.filter("u > 0")).first()
    assert r.node_count and not r.edge_count and not r.degree_sequence and not r.wl_hash and not r.components


def test_layers_refuse_bad_input(spark):
    layers = overlay.Layers()
    assert layers.summarise() == "No project layers attached."
    df = spark.range(3)
    assert layers.add("a", "points", df) == 3
    with pytest.raises(ValueError, match="already exists"):
        layers.add("a", "points", df)
    with pytest.raises(ValueError, match="no features"):
        layers.add("b", "points", df.limit(0))
    with pytest.raises(TypeError):
        layers.add("c", "points", 42)


def test_reembedding_on_a_curve_with_pins_and_keys(spark):
    n, e = grid(spark, 5, 4)
    curve = [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0)]
    at = lambda df: {r.node_id: (r.x, r.y) for r in df.collect()}
    on = at(reembed.reembed(n, e, 300, curve=curve))
    rim = [p for p in on.values() if min(abs(p[0] - 20), abs(p[0] - 30), abs(p[1]), abs(p[1] - 10)) < 1e-9]
    assert len(rim) == 14 and all(20 - 1e-9 <= x <= 30 + 1e-9 and -1e-9 <= y <= 10 + 1e-9 for x, y in on.values())
    first = n.orderBy("node_id").first().node_id
    pins = spark.createDataFrame([(first, -3.0, -4.0)], "node_id long, x double, y double")
    assert at(reembed.reembed(n, e, 300, pins=pins))[first] == (-3.0, -4.0)
    one, again, other = (at(reembed.reembed(n, e, 100, key=bytes([k]) * 32)) for k in (1, 1, 2))
    assert one == again and any(abs(one[i][0] - other[i][0]) > 1e-3 for i in one)
    loose = at(reembed.reembed(n, e, 100, preserve_lengths=False, preserve_areas=False))
    assert max(abs(loose[i][0] - x) for i, (x, _) in at(reembed.reembed(n, e, 100, tutte_only=True)).items()) < 1e-2


def test_round_trip_sees_missing_nodes(spark):
    n, _ = grid(spark, 3, 3)
    assert verify.round_trip(n, n).first().same and not verify.round_trip(n, n.filter("node_id > 0")).first().same
