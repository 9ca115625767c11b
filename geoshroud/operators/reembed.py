"""Re-embedding: barycentric start, then stress on edge lengths and face areas, one component per group.

Components are independent groups.  A component reaches its task as plain columns, so one of any size takes 68 bytes a
node, edge and half-edge there.  One of more than ``BLOCK`` nodes gets its start there only; its stress is lowered by blocks
in tasks of their own, and each turn starts from what all blocks of the last one left.
"""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .faces import face_areas, half_edges
from .graph import edge_lengths
from .iterate import components, keep
from .pieces import BLOCK, PIECE, SHARES, cut, members, opened

#: Turns over all blocks in a phase; each takes its part of the rounds.
TURNS = 4


def tutte(n: int, u: np.ndarray, v: np.ndarray, outer: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Barycentric layout with the outer nodes at ``place``: conjugate gradients on the inner nodes."""
    p = np.zeros((n, 2))
    p[outer] = place
    inner = np.ones(n, bool)
    inner[outer] = False
    if not inner.any():
        return p
    deg = (np.bincount(u, minlength=n) + np.bincount(v, minlength=n))[inner]
    deg = np.maximum(deg, 1).astype(float)
    # x and y as one complex number a node, edges between inner nodes as runs of neighbours
    place, at, m = p[:, 0] + 1j * p[:, 1], np.cumsum(inner) - 1, len(deg)
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    rim, core = inner[a] & ~inner[b], inner[a] & inner[b]
    to, by = at[a[rim]], place[b[rim]]
    r = np.bincount(to, by.real, m) + 1j * np.bincount(to, by.imag, m)
    a, b = at[a[core]], at[b[core]]
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    has = slice(None) if len(first) == m else a[first]
    ends, flat = np.empty(len(b), complex), lambda c: c.view(float)
    x, q, z = np.zeros(m, complex), np.empty(m, complex), r / deg
    d, end = z.copy(), 1e-12 * max(1.0, np.abs(p).max())
    rz = flat(r) @ flat(z)
    for _ in range(10 * n + 100):
        if max(flat(r).max(), -flat(r).min()) < end:
            break
        np.multiply(d, deg, out=q)
        if len(b):
            q[has] -= np.add.reduceat(np.take(d, b, out=ends, mode="clip"), first)
        step = rz / max(flat(d) @ flat(q), 1e-300)
        x += np.multiply(d, step, out=z)
        r -= np.multiply(q, step, out=z)
        np.divide(r, deg, out=z)
        new = flat(r) @ flat(z)
        d *= new / max(rz, 1e-300)
        d += z
        rz = new
    p[inner] = np.stack([x.real, x.imag], 1)
    return p


def lbfgs(f, x: np.ndarray, rounds: int, memory: int = 12, ftol: float = 1e-10) -> np.ndarray:
    """Two-loop recursion with Armijo backtracking."""
    value, g = f(x)
    hist: list[tuple[np.ndarray, np.ndarray, float]] = []
    part = np.empty_like(x)
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(hist):
            a = r * (s @ q)
            alphas.append(a)
            q -= np.multiply(y, a, out=part)
        if hist:
            s, y, _ = hist[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).max() * 100)
        for (s, y, r), a in zip(hist, reversed(alphas)):
            q += np.multiply(s, a - r * (y @ q), out=part)
        slope = -(g @ q)
        if slope >= 0:
            hist, q, slope = [], g / max(1.0, np.abs(g).max() * 100), -(g @ g) / max(1.0, np.abs(g).max() * 100)
        t = 1.0
        while True:
            nv, ng = f(x - t * q)
            if nv <= value + 1e-4 * t * slope or t < 1e-12:
                break
            t *= 0.5
        if t < 1e-12 or value - nv <= ftol * max(abs(value), abs(nv), 1e-12):
            return x - t * q if nv < value else x
        s, y = -t * q, ng - g
        if s @ y > 1e-14:
            hist = [*hist, (s, y, 1 / (s @ y))][-memory:]
        x, value, g = x + s, nv, ng
    return x


def sides(n: int, u: np.ndarray, v: np.ndarray, faces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges u, v with the faces on their left and right (-1: none); half-edges without an edge are added at the end.

    The i-th half-edge from a to b belongs to the i-th edge between a and b.
    """
    fa, fb, ff = faces

    def numbered(key):  # the place of each among its equals
        by = np.argsort(key, kind="stable")
        k = key[by]
        out = np.empty(len(key), np.int64)
        out[by] = np.arange(len(key)) - np.searchsorted(k, k, "left")
        return out

    edge = np.minimum(u, v) * n + np.maximum(u, v)
    half = np.minimum(fa, fb) * n + np.maximum(fa, fb)
    at, turn = numbered(edge), numbered(2 * half + (fa > fb))
    many = max(at.max(initial=0), turn.max(initial=0)) + 1
    edge, half = edge * many + at, half * many + turn
    new = np.setdiff1d(half, edge)
    u, v = np.concatenate([u, new // many // n]), np.concatenate([v, new // many % n])
    edge = np.concatenate([edge, new])
    by = np.argsort(edge, kind="stable")
    of = by[np.searchsorted(edge[by], half)]
    left, right = np.full(len(u), -1), np.full(len(u), -1)
    same = fa == u[of]
    left[of[same]], right[of[~same]] = ff[same], ff[~same]
    return u, v, left, right


def stress(n, u, v, length, faces, areas, weight: float, fixed: np.ndarray | None = None, edge_weight: float = 1.0):
    """Function and gradient of edge_weight*sum((|p_u-p_v|-d)^2/d^2) + weight*sum((|A|-A*)^2/A*^2) over all x, then all y;
    faces as (a, b, face) half-edges.  Nodes marked in ``fixed`` have no gradient, so they stay where they are.

    An edge gives its cross product to the face on its left and takes it from the one on its right, so both terms need the
    ends of each edge once only.
    """
    weighs, m = weight and len(areas), len(u)
    if weighs:
        u, v, left, right = sides(n, u, v, faces)
        left, right = np.where(left < 0, len(areas), left), np.where(right < 0, len(areas), right)
    d = np.maximum(length, 1e-12)
    w, a2 = edge_weight / d**2, np.maximum(areas, 1e-12) ** 2

    def f(z):
        x, y = z[:n], z[n:]
        xu, yu, xv, yv = x[u], y[u], x[v], y[v]
        ex, ey = (xu - xv)[:m], (yu - yv)[:m]
        r = np.maximum(np.sqrt(ex * ex + ey * ey), 1e-12)
        gap = r - length
        k = w * gap
        value = float(k @ gap)
        k *= 2
        k /= r
        ex *= k
        ey *= k
        if not weighs:
            g = np.concatenate([np.bincount(u, ex, n) - np.bincount(v, ex, n), np.bincount(u, ey, n) - np.bincount(v, ey, n)])
        else:
            cross = xu * yv - xv * yu
            A = 0.5 * (np.bincount(left, cross, len(areas) + 1) - np.bincount(right, cross, len(areas) + 1))[:-1]
            gap = np.abs(A) - areas
            c = gap / a2
            value += weight * float(c @ gap)
            c = np.append(weight * c * np.sign(A), 0.0)
            c = c[left] - c[right]
            xu *= c
            yu *= c
            xv *= c
            yv *= c
            yv[:m] += ex
            yu[:m] += ex
            xv[:m] -= ey
            xu[:m] -= ey
            g = np.concatenate([np.bincount(u, yv, n) - np.bincount(v, yu, n), np.bincount(v, xu, n) - np.bincount(u, xv, n)])
        if fixed is not None:
            g[:n][fixed] = 0
            g[n:][fixed] = 0
        return value, g

    return f


def along(curve: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc length along a closed curve."""
    step = np.hypot(*(np.roll(curve, -1, axis=0) - curve).T)
    at = np.arange(n) * step.sum() / n
    ends, closed = np.concatenate([[0], np.cumsum(step)]), np.concatenate([curve, curve[:1]])
    return np.stack([np.interp(at, ends, closed[:, i]) for i in range(2)], 1)


def _area(p: np.ndarray) -> float:
    return 0.5 * float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())


def _start(ids, x, y, u, v, length, areas, outer, tutte_only, turn, curve=None, pins=None) -> tuple:
    """Start of one component, the nodes that are held (None: nothing is left to do), lengths and areas to aim at.
    ``pins`` is (n, 2) with NaN where a node is free."""
    n, old = len(ids), np.stack([x, y], 1)
    pinned = np.isfinite(pins).all(1) if pins is not None else np.zeros(n, bool)
    if n < 3 or len(outer) < 3:
        return np.where(pinned[:, None], pins, old) if pins is not None else old, None, length, areas
    at = np.roll(outer, turn % len(outer))
    if curve is not None:
        ring = curve if _area(curve) * _area(old[outer]) >= 0 else curve[::-1]
        p = tutte(n, u, v, at, along(ring, len(at)))
        k = np.sqrt(abs(_area(curve)) / max(abs(_area(old[outer])), 1e-12))  # lengths and areas to the size of the curve
        length, areas, span = length * k, areas * k * k, np.ptp(curve, axis=0)
    else:
        step = np.hypot(x[at] - x[np.roll(at, -1)], y[at] - y[np.roll(at, -1)])
        angle = 2 * np.pi * np.concatenate([[0], np.cumsum(step)[:-1]]) / max(step.sum(), 1e-12)
        p = tutte(n, u, v, at, np.stack([np.cos(angle), np.sin(angle)], 1))
        span, have = np.array([np.ptp(x), np.ptp(y)]), np.maximum(np.ptp(p, axis=0), 1e-12)
        p = (p - (p.max(0) + p.min(0)) / 2) * (span / have).min() + np.array([(x.max() + x.min()) / 2, (y.max() + y.min()) / 2])
    fixed = pinned.copy()
    if curve is not None:
        fixed[at] = True
    if pinned.any():
        p = np.where(pinned[:, None], pins, p)
    if tutte_only:
        return p, None, length, areas
    jitter = np.stack([np.sin(ids * 12.9898 + 1), np.cos(ids * 78.233)], 1) * 1e-4 * max(span.max(), 1e-12)
    return np.where(fixed[:, None], p, p + jitter), fixed, length, areas


def _lower(p, u, v, length, faces, areas, fixed, weight: float, edge_weight: float, rounds: int) -> np.ndarray:
    f = stress(len(p), u, v, length, faces, areas, weight, fixed, edge_weight)
    return lbfgs(f, p.T.ravel(), rounds).reshape(2, -1).T


def _by_block(weight: float, edge_weight: float, rounds: int):
    def lower(piece: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        mark, *of = opened(piece.iloc[0])
        ends = ends.sort_values("node_id")
        p = _lower(ends[["x", "y"]].to_numpy(), *of, mark != 2, weight, edge_weight, rounds)
        return pd.DataFrame({"node_id": ends["node_id"].to_numpy(), "x": p[:, 0], "y": p[:, 1]})[mark > 0]

    return lower


def reembed(
    nodes: DataFrame, edges: DataFrame, rounds: int = 2000, tutte_only: bool = False, turn: int = 0, key: bytes | None = None,
    preserve_lengths: bool = True, preserve_areas: bool = True, curve: list[tuple[float, float]] | None = None, pins: DataFrame | None = None,
) -> DataFrame:
    """``node_id, x, y``: new coordinates with the lengths and face areas of the old ones, by component.

    ``turn`` shifts the start of the outer cycle on its curve; with a ``key`` that is drawn from the key and the component's
    least node, so the output depends on it.  ``curve`` is a closed outline (its first point not repeated) on which the outer
    cycle is put at equal arc lengths and held, all targets scaled to its size; without it the layout keeps the old bounding box.
    ``pins`` (node_id, x, y) are held where they say.
    """
    comp = keep(components(nodes, edges), "components")
    half = keep(half_edges(nodes, edges), "faces")
    areas = face_areas(half)
    nan = F.lit(float("nan"))
    held = nodes.select("node_id", "x", "y")
    held = held.join(pins.select("node_id", F.col("x").alias("px"), F.col("y").alias("py")), "node_id", "left") if pins is not None else held.withColumn("px", nan).withColumn("py", nan)
    held = held.select("node_id", "x", "y", F.coalesce("px", nan).alias("px"), F.coalesce("py", nan).alias("py"))
    outline, has_pins = None if curve is None else np.array(curve, float), pins is not None
    of_u, no, none = comp.withColumnRenamed("node_id", "u"), F.lit(0).cast("long"), F.lit(None).cast("double")
    # one long table of nodes (0), edges (1) and half-edges (2)
    parts = held.join(comp, "node_id").select("component", F.lit(0).alias("kind"), F.col("node_id").alias("u"), no.alias("v"), no.alias("face"), F.col("x").alias("p"), F.col("y").alias("q"), F.col("px").alias("px"), F.col("py").alias("py"))
    parts = parts.union(edge_lengths(edges, nodes).join(of_u, "u").select("component", F.lit(1), "u", "v", no, "length", none, none, none))
    phases = [(0.0, 1.0)] * preserve_lengths + [(10.0, float(preserve_lengths))] * preserve_areas
    parts = parts.union(half.join(areas, "face").join(of_u, "u").select("component", F.lit(2), "u", "v", "face", "area", none, none, none))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        pick = lambda k, *columns: [pdf[c].to_numpy()[kind == k] for c in columns]
        ids, x, y, px, py = pick(0, "u", "p", "q", "px", "py")
        by = np.argsort(ids)
        ids, x, y, held_at = ids[by], x[by].astype(float), y[by].astype(float), np.stack([px, py], 1)[by]
        eu, ev, length = pick(1, "u", "v", "p")
        by = np.lexsort((length, ev, eu))
        eu, ev, length = (np.searchsorted(ids, eu[by]), np.searchsorted(ids, ev[by]), length[by].astype(float))
        hu, hv, face, area = pick(2, "u", "v", "face", "p")
        by = np.lexsort((hv, hu, face))
        hu, hv, face, area = (np.searchsorted(ids, hu[by]), np.searchsorted(ids, hv[by]), face[by], area[by].astype(float))
        out_face = face[np.argmin(area)] if len(area) else None
        nxt = dict(zip(hu[face == out_face].tolist(), hv[face == out_face].tolist())) if len(area) else {}
        ring, k = [], next(iter(sorted(nxt)), None)
        while k is not None and k not in ring[:1] and len(ring) <= len(nxt):
            ring.append(k)
            k = nxt.get(k)
        inner = face != out_face
        names, ff = np.unique(face[inner], return_inverse=True)
        target = np.zeros(len(names))
        target[ff] = np.abs(area[inner])
        seen = list(dict.fromkeys(ring))[::-1]
        drawn = turn if key is None else int.from_bytes(hmac.new(key, b"turn %d" % ids[0], hashlib.sha256).digest()[:8], "big")
        p, fixed, length, target = _start(ids, x, y, eu, ev, length, target, np.array(seen, np.int64), tutte_only, drawn, outline, held_at if has_pins else None)
        faces, many = (hu[inner], hv[inner], ff), fixed is not None and len(ids) > BLOCK
        for weight, edge_weight in phases if fixed is not None and not many else []:
            p = _lower(p, eu, ev, length, faces, target, fixed, weight, edge_weight, rounds)
        out = pd.DataFrame({"component": pdf["component"].iloc[0], "node_id": pd.array(ids, "Int64"), "x": p[:, 0], "y": p[:, 1], "many": many})
        out = out.assign(**dict.fromkeys(columns[5:]))
        if many:
            rows = pd.DataFrame(list(cut(ids, x, y, ~fixed, eu, ev, length, faces, target)), columns=columns[5:])
            out = pd.concat([out, rows.assign(component=out["component"].iloc[0], many=True)])
        return out[columns]

    columns = ["component", "node_id", "x", "y", "many", *(c.split()[0] for c in PIECE.split(", "))]
    start = parts.groupBy("component").applyInPandas(one, f"component long, node_id long, x double, y double, many boolean, {PIECE}")
    if tutte_only or not phases:
        return start.select("node_id", "x", "y")
    start = keep(start, "start")
    done = start.filter("not many").select("node_id", "x", "y")
    blocks = start.filter("turn is not null").drop("node_id", "x", "y", "many")
    turns = [r["turn"] for r in blocks.select("turn").distinct().collect()]
    if not turns:
        return done
    at = keep(blocks.select("component", "turn", "block", "at").mapInPandas(members, "component long, turn int, block int, node_id long"), "members")
    blocks = blocks.drop("at")
    tasks = max(4 * start.sparkSession.sparkContext.defaultParallelism, int(start.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = start.filter("many and turn is null").select("node_id", "x", "y")
    order = [k % len(SHARES) for k in range(TURNS)] + [len(SHARES)] * (len(SHARES) in turns)
    for weight, edge_weight in phases:
        for k in order:
            rest = k == len(SHARES)
            lower = _by_block(weight, edge_weight, rounds if rest else -(-rounds // TURNS))
            mine = blocks.filter(F.col("turn") == k)
            ends = at.filter(F.col("turn") == k).drop("turn").join(now, "node_id")
            by = ["component", "block"]
            new = mine.repartition(tasks, *by).groupBy(*by).cogroup(ends.repartition(tasks, *by).groupBy(*by)).applyInPandas(lower, "node_id long, x double, y double")
            new = keep(new, "turn")
            now = new.union(now.join(new, "node_id", "left_anti")) if rest else new
    return done.union(now)
