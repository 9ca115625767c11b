"""Components of the whole lattice, which hangs together, against a union-find."""

from __future__ import annotations

from geoshroud.plans.catalog import QUERIES
from geoshroud.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


def test_components_of_the_whole_lattice(spark):
    i = Inputs(spark, SF)
    edges = [(r.u, r.v) for r in i.edges.collect()]
    up = {r.node_id: r.node_id for r in i.nodes.collect()}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        if u in up and v in up:
            x, y = sorted((root(u), root(v)))
            up[y] = x
    want = {x: root(x) for x in list(up)}
    got = {r.node_id: r.component for r in QUERIES["graph_components_whole"](spark, SF).collect()}
    assert got == want
    sizes = {c: sum(x == c for x in want.values()) for c in set(want.values())}
    top = min(sizes, key=lambda c: (-sizes[c], c))
    assert sizes[top] > 0.9 * len(want)
    rows = QUERIES["largest_component_edges_whole"](spark, SF).select("u", "v").collect()
    assert sorted(map(tuple, rows)) == sorted((u, v) for u, v in edges if want.get(u) == top and want.get(v) == top)
