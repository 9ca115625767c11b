"""A component cut into blocks that can be optimised side by side: what joins two blocks holds still on one side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Nodes of a block at most; larger components go by blocks.
BLOCK = 4000
#: Where boxes are cut; turns take them one after the other, so that what one holds still is free in the next.
SHARES = (0.5, 0.38)
PIECE = "turn int, block int, at binary, mark binary, ints binary, reals binary"


def boxes(x: np.ndarray, y: np.ndarray, most: int, share: float) -> np.ndarray:
    """The block of each node: boxes of at most ``most`` nodes, cut across their longer side at ``share`` of their nodes."""
    out, todo, k = np.zeros(len(x), np.int64), [np.arange(len(x))], 0
    while todo:
        i = todo.pop()
        if len(i) <= most:
            out[i], k = k, k + 1
            continue
        along = x if np.ptp(x[i]) >= np.ptp(y[i]) else y
        i = i[np.argsort(along[i], kind="stable")]
        at = min(max(int(len(i) * share), 1), len(i) - 1)
        todo += [i[:at], i[at:]]
    return out


def hold(block: np.ndarray, free: np.ndarray, u, v, fa, ff, late: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes that stay free, and the blocks of edges and faces: the least (``late``: the largest) of their nodes' blocks.

    Nodes of another block on an edge or face hold still, so no edge or face has free nodes of two blocks, and blocks
    optimised at the same time lower the sum over all.  Half-edges come sorted by face, numbered from 0.
    """
    pick = np.maximum if late else np.minimum
    of_edge = pick(block[u], block[v])
    of_face = pick.reduceat(block[fa], np.flatnonzero(np.diff(ff, prepend=-1))) if len(ff) else np.zeros(0, np.int64)
    free = free.copy()
    free[u[block[u] != of_edge]] = False
    free[v[block[v] != of_edge]] = False
    free[fa[block[fa] != of_face[ff]]] = False
    return free, of_edge, of_face


def cut(ids, x, y, free, u, v, length, faces, areas, most: int = BLOCK) -> Iterator[tuple]:
    """``turn, block, nodes, mark, ints, reals`` of every block of every turn; mark is 0 for a node of another block, 1 for
    one that holds still, 2 for a free one.  Nodes that no turn leaves free (on faces larger than blocks) are one more turn.
    """
    fa, fb, ff = faces
    never = free.copy()
    for turn, share in enumerate((*SHARES, None)):
        if share is None:
            if not never.any():
                return
            block, loose = np.where(never, 0, -1), never
            of_edge, of_face = np.zeros(len(u), np.int64), np.zeros(len(areas), np.int64)
        else:
            block = boxes(x, y, most, share)
            loose, of_edge, of_face = hold(block, free, u, v, fa, ff, bool(turn % 2))
            never &= ~loose
        live = np.zeros(len(areas), bool)
        live[ff[loose[fa]]] = True
        e, h = np.flatnonzero(loose[u] | loose[v]), np.flatnonzero(live[ff])
        e, h = e[np.argsort(of_edge[e], kind="stable")], h[np.argsort(of_face[ff[h]], kind="stable")]
        home = np.argsort(block, kind="stable")
        kinds = (block[home], of_edge[e], of_face[ff[h]])
        for b in range(block.max() + 1):
            (i, j), (k, l), (m, o) = (np.searchsorted(of, [b, b + 1]) for of in kinds)
            own, e_, h_ = home[i:j], e[k:l], h[m:o]
            at = np.unique(np.concatenate([own, u[e_], v[e_], fa[h_], fb[h_]]))
            names, f = np.unique(ff[h_], return_inverse=True)
            mark = np.where(block[at] == b, 1 + loose[at], 0)
            ends = [np.searchsorted(at, q) for q in (u[e_], v[e_], fa[h_], fb[h_])]
            ints = np.concatenate([[len(e_), len(h_)], *ends, f])
            yield turn, b, ids[at].tobytes(), mark.astype(np.uint8).tobytes(), ints.astype(np.int32).tobytes(), np.concatenate([length[e_], areas[names]]).tobytes()


def opened(row: pd.Series) -> tuple[np.ndarray, ...]:
    """``mark, u, v, length, (a, b, face), areas`` of a block's row."""
    ints, reals = np.frombuffer(row["ints"], np.int32).astype(np.int64), np.frombuffer(row["reals"])
    n, m = ints[:2]
    u, v, fa, fb, ff = np.split(ints[2:], np.cumsum([n, n, m, m]))
    return np.frombuffer(row["mark"], np.uint8), u, v, reals[:n], (fa, fb, ff), reals[n:]


def members(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each node of each block, those of other blocks that it sees included."""
    for pdf in pieces:
        for c, t, b, at in zip(pdf["component"], pdf["turn"], pdf["block"], pdf["at"]):
            yield pd.DataFrame({"component": c, "turn": t, "block": b, "node_id": np.frombuffer(at, np.int64)})
