"""Language identification against plain Python: counts of n-grams, bit classifiers, loss-weighted decoding."""

from __future__ import annotations

import collections
import itertools
import math
import random
import zlib

import pytest

from geoshroud.llm import language_id


def grams(text):
    b = b" " + bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode()) + b" "
    out = list(b)
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            h = 0
            for x in b[i : i + n]:
                h = (h * 257 + x + 1) % 2**32
            out.append((h * 2654435761 % 2**32 >> 8) % language_id.CELLS)
    return out


def test_predictions_by_brute_force(spark):
    r = random.Random(4)
    words = {"aa": "the of and that", "bb": "der die und nicht", "cc": "las los que con", "dd": "thé ôf ånd dér"}
    rows = [(i, " ".join(r.choice(words[x].split() + words["aa"].split()[:1]) for _ in range(r.randint(1, 12))), x) for i, x in ((i, "abcd"[i % 4] * 2) for i in range(120))]
    rows += [(200, "THE OF", None), (201, None, "aa")]
    got = {x.doc_id: x for x in language_id.predict(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    counts = {x: collections.Counter() for x in sorted(words)}
    for i, t, x in rows:
        if t and x and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[x].update(grams(t))
    cells = language_id.CELLS
    p = {x: [(c[k] + 0.5) / (sum(c.values()) + cells / 2) for k in range(cells)] for x, c in counts.items()}
    langs = sorted(words)
    codes = [[1, *bits] for bits in itertools.product((1, -1), repeat=3)][1:]  # bit by bit, a sign for every language
    weights, trust = [], []
    for code in codes:
        one, zero = ([x for x, s in zip(langs, code) if s == sign] for sign in (1, -1))
        w = [math.log(sum(p[x][k] for x in one) / len(one)) - math.log(sum(p[x][k] for x in zero) / len(zero)) for k in range(cells)]
        weights.append(w)
        trust.append(max(0.05, min(s * sum(a * b for a, b in zip(p[x], w)) for x, s in zip(langs, code))))
    trust = [t / sum(trust) * len(trust) for t in trust]
    for i, t, _ in rows:
        if t is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        g = grams(t)
        margins = [sum(w[k] for k in g) / len(g) for w in weights]
        loss = [sum(math.log1p(math.exp(-8 * code[j] * m)) * u for code, m, u in zip(codes, margins, trust)) * 8 / len(trust) for j in range(4)]
        share = [math.exp(min(loss) - x) / sum(math.exp(min(loss) - y) for y in loss) for x in loss]
        best = max(range(4), key=lambda j: share[j])
        assert got[i].lang_pred == langs[best] and got[i].score == pytest.approx(share[best], abs=1e-6)
        assert got[i].ambiguous == (share[best] - sorted(share)[-2] < language_id.CLOSE)
