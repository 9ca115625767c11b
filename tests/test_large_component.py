"""Re-embedding of a component of more than 100,000 nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoshroud.operators import reembed

W, H = 34, 3000


@pytest.fixture(scope="module")
def lattice(spark):
    n = spark.range(W * H).select(F.col("id").alias("node_id"), (F.col("id") % W).cast("double").alias("x"), F.floor(F.col("id") / W).cast("double").alias("y"))
    across = n.filter(F.col("x") < W - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"))
    return n, across.union(n.filter(F.col("y") < H - 1).select("node_id", F.col("node_id") + W))


def grid(df):
    p = df.toPandas().sort_values("node_id")
    assert p["node_id"].tolist() == list(range(W * H))
    return p[["x", "y"]].to_numpy().reshape(H, W, 2)


def test_inner_nodes_of_a_large_component_are_means_of_their_neighbours(lattice):
    p = grid(reembed.reembed(*lattice, tutte_only=True))
    mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
    assert np.abs(p[1:-1, 1:-1] - mean).max() < 1e-6
    assert np.ptp(p[..., 0]) <= W - 1 + 1e-6 and np.ptp(p[..., 1]) <= H - 1 + 1e-6


def test_a_large_component_is_optimised(lattice):
    start, p = grid(reembed.reembed(*lattice, tutte_only=True)), grid(reembed.reembed(*lattice, rounds=3))
    off = lambda q: np.concatenate([(np.hypot(*np.moveaxis(np.diff(q, axis=i), -1, 0)) - 1).ravel() for i in (0, 1)])
    assert np.isfinite(p).all() and (off(p) ** 2).sum() < (off(start) ** 2).sum()
