"""Re-embedding by blocks: what may move at the same time, and the stress against one run over the whole component."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoshroud.operators import pieces, reembed
from geoshroud.operators.faces import face_areas, half_edges

W, H = 60, 100


def wheel(n):
    """A ring of n nodes around one large face; its node i has a neighbour n + i further out."""
    i = np.arange(n)
    x, y = (np.concatenate([r * f(2 * np.pi * i / n) for r in (1, 2)]) for f in (np.cos, np.sin))
    u, v = np.concatenate([i, i]), np.concatenate([(i + 1) % n, n + i])
    return x, y, u, v, np.ones(2 * n), (i, (i + 1) % n, np.zeros(n, np.int64)), np.array([3.0])


def test_every_node_is_free_once_and_no_edge_or_face_moves_from_two_blocks():
    x, y, u, v, length, faces, areas = wheel(300)
    ids, fixed = np.arange(600) * 10, np.arange(600) == 7
    moved, edges = np.zeros(600, int), {}
    for turn, block, at, mark, ints, reals in pieces.cut(ids, x, y, ~fixed, u, v, length, faces, areas, most=50):
        at, row = np.frombuffer(at, np.int64) // 10, {"mark": mark, "ints": ints, "reals": reals}
        mark, a, b, d, (fa, fb, ff), sizes = pieces.opened(row)
        assert (np.diff(at) > 0).all() and set(sizes) <= {3.0} and len(d) == len(a)
        assert len(fa) in (0, 300) and (not len(fa) or set(at[fa]) == set(range(300)))  # faces travel whole
        moved[at[mark == 2]] += 1
        for k, name in [*((tuple(sorted(e)), "edge") for e in zip(at[a], at[b])), *([("face", "face")] if len(fa) else [])]:
            assert edges.setdefault((turn, k, name), block) == block  # in one block a turn
        inside = set(zip(at[a], at[b]))
        free = set(at[mark == 2])
        assert all((p, q) in inside for p, q in zip(u, v) if p in free or q in free)  # with all edges of its free nodes
    assert (moved[~fixed] > 0).all() and moved[7] == 0


@pytest.fixture(scope="module")
def lattice(spark):
    n = spark.range(W * H).select(F.col("id").alias("node_id"), (F.col("id") % W + (F.col("id") * 7 % 5) / 20).alias("x"), (F.floor(F.col("id") / W) + (F.col("id") * 11 % 7) / 30).alias("y"))
    across = n.filter(F.col("node_id") % W < W - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"))
    return n, across.union(n.filter(F.col("node_id") < W * (H - 1)).select("node_id", F.col("node_id") + W))


def test_blocks_reach_the_stress_of_one_run_over_all(lattice):
    n, e = lattice
    assert W * H > pieces.BLOCK
    at = lambda df: df.toPandas().sort_values("node_id")[["x", "y"]].to_numpy()
    half = half_edges(n, e)
    faces = half.join(face_areas(half).filter("area > 0"), "face").toPandas().sort_values(["face", "u", "v"])
    names, ff = np.unique(faces["face"], return_inverse=True)
    areas = np.zeros(len(names))
    areas[ff] = faces["area"]
    u, v = e.toPandas()[["u", "v"]].to_numpy().T
    old, start = at(n), at(reembed.reembed(n, e, tutte_only=True))
    args = u, v, np.hypot(*(old[u] - old[v]).T), (faces["u"].to_numpy(), faces["v"].to_numpy(), ff), areas
    value = lambda p: reembed.stress(len(p), *args, 10.0)(p.T.ravel())[0]
    whole = start
    for weight in (0.0, 10.0):
        whole = reembed.lbfgs(reembed.stress(len(whole), *args, weight), whole.T.ravel(), 600).reshape(2, -1).T
    assert value(at(reembed.reembed(n, e, 600))) < 1.05 * value(whole)


def test_held_nodes_of_a_component_of_blocks_stay(spark, lattice):
    n, e = lattice
    pins = spark.createDataFrame([(W * 50 + 30, 12.5, -3.25)], "node_id long, x double, y double")
    curve = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    p = reembed.reembed(n, e, 8, curve=curve, pins=pins).toPandas().set_index("node_id").sort_index()
    q = reembed.reembed(n, e, 8, curve=curve, pins=pins, tutte_only=True).toPandas().set_index("node_id").sort_index()
    assert len(p) == W * H and tuple(p.loc[W * 50 + 30]) == (12.5, -3.25)
    rim = (p.index % W == 0) | (p.index % W == W - 1) | (p.index < W) | (p.index >= W * (H - 1))
    assert np.array_equal(p[rim].to_numpy(), q[rim].to_numpy()) and (p[~rim].to_numpy() != q[~rim].to_numpy()).any(1).sum() >= (~rim).sum() - 1
