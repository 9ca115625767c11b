"""Number of links of every row, inside components too, against brute force."""

from __future__ import annotations

import random
import re

import pytest

from geoshroud.llm import ngram_join


@pytest.mark.parametrize("block", [256, 3])
def test_links_inside_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(300)]
    texts = [None, "", "one", "one"]
    for _ in range(4):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(10, texts[10]), (99, texts[12])]
    sets = []
    for _, t in rows:
        w = re.findall(r"\S+", t or "")
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    want = [(i, sum(a != b and bool(y) and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(sets))) for a, ((i, _), x) in enumerate(zip(rows, sets))]
    got = ngram_join.jaccard_links(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted(want)
    assert any(0 < n < 13 for _, n in want)
