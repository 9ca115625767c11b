"""Vectorised byte-string hashing in numpy: 64-bit polynomial hashes of any spans of a text in O(bytes)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII white space: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 20


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 12)
        with np.errstate(over="ignore"):
            p, i = np.full(size, _P, U64), np.full(size, _PINV, U64)
            p[0] = i[0] = 1
            _POW, _INV = np.cumprod(p, dtype=U64), np.cumprod(i, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(a: np.ndarray) -> np.ndarray:
    """c with c[e]-c[s] = hash of a[s:e] times P**s."""
    _powers(len(a) + 1)
    c = np.empty(len(a) + 1, U64)
    c[0] = 0
    np.cumsum(_TABLE[a] * _POW[: len(a)], dtype=U64, out=c[1:])
    return c


def span_hashes(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans [s, e)."""
    return mix((c[e] - c[s]) * _INV[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans(a: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``gap`` (by byte value) is False."""
    g = np.ones(len(a) + 2, bool)
    g[1:-1] = gap[a]
    edges = np.flatnonzero(g[1:] != g[:-1])
    return edges[::2], edges[1::2]


def pieces(b: bytes, gap: np.ndarray = SPACE):
    """Cut a long text at gap bytes into parts of about CHUNK bytes; no word is cut."""
    at = 0
    while at < len(b):
        end = min(len(b), at + CHUNK)
        while end < len(b) and not gap[b[end]]:
            end += 1
        yield b[at:end]
        at = end


def word_hashes(b: bytes, gap: np.ndarray = SPACE) -> np.ndarray:
    """Hash of every word, in order."""
    out = []
    for part in pieces(b, gap):
        a = np.frombuffer(part, np.uint8)
        s, e = spans(a, gap)
        if len(s):
            out.append(span_hashes(prefix_sums(a), s, e))
    return np.concatenate(out) if out else np.empty(0, U64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct int64 hashes of the k-word shingles of the A-Z-lower-cased text.

    Fewer than k words: the whole sequence is one shingle; no word: empty.
    """
    if not text:
        return np.empty(0, np.int64)
    w = word_hashes(text.translate(LOWER))
    if not len(w):
        return np.empty(0, np.int64)
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, U64(width))
    for j in range(width):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[j : len(w) - width + 1 + j])
    return np.unique(h.view(np.int64))
