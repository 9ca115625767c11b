"""The optimiser's function: against the plain sums, and its time by the time of one sum over all edges."""

import inspect
import time

import numpy as np

from geoshroud.operators import reembed

# a square and a triangle on its side 1-2, which is doubled; 4-5 hangs outside and has no face; 6-0 has half-edges but no edge
U, V = np.array([0, 1, 1, 2, 3, 1, 2, 4]), np.array([1, 2, 2, 3, 0, 4, 4, 5])
FACES = np.array([0, 1, 2, 3, 1, 4, 2, 2, 1, 0, 6]), np.array([1, 2, 3, 0, 4, 2, 1, 1, 2, 6, 0]), np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2])


def plain(z, length, areas, weight):
    p = z.reshape(2, -1).T
    a, b, f = FACES
    A = 0.5 * np.bincount(f, p[a, 0] * p[b, 1] - p[b, 0] * p[a, 1], len(areas))
    return (((np.hypot(*(p[U] - p[V]).T) - length) / length) ** 2).sum() + weight * (((np.abs(A) - areas) / areas) ** 2).sum()


def test_stress_is_the_plain_sum_and_its_gradient():
    rng = np.random.default_rng(3)
    z, length, areas = rng.uniform(0, 3, 14), rng.uniform(1, 2, len(U)), rng.uniform(1, 2, 3)
    for weight in (0.0, 10.0):
        value, g = reembed.stress(7, U, V, length, FACES, areas, weight)(z)
        assert np.isclose(value, plain(z, length, areas, weight), rtol=1e-12)
        step = np.eye(14) * 1e-6
        assert np.allclose(g, [(plain(z + s, length, areas, weight) - plain(z - s, length, areas, weight)) / 2e-6 for s in step], atol=1e-4 * np.abs(g).max())


def fastest(f):
    took = []
    for _ in range(7):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return min(took)


def test_a_large_component_costs_few_sums_a_round():
    w, h = 40, 3000
    n = w * h
    i = np.arange(n)
    u, v = np.concatenate([i[i % w < w - 1], i[:-w]]), np.concatenate([i[i % w < w - 1] + 1, i[w:]])
    c = i[:-w][i[:-w] % w < w - 1]
    quad = np.stack([c, c + 1, c + w + 1, c + w], 1)
    faces = quad.ravel(), np.roll(quad, -1, axis=1).ravel(), np.repeat(np.arange(len(c)), 4)
    rng = np.random.default_rng(4)
    z, weights = rng.uniform(0, 40, 2 * n), rng.uniform(size=len(u))
    named = {"n": n} if "n" in inspect.signature(reembed.stress).parameters else {}
    f = reembed.stress(**named, u=u, v=v, length=np.ones(len(u)), faces=faces, areas=np.ones(len(c)), weight=10.0)
    assert fastest(lambda: f(z)) < 80 * fastest(lambda: np.bincount(u, weights, n))
