"""A small language beside a large one: its own toxic words count however many labels the other has."""

from __future__ import annotations

import random

from geoshroud.llm import toxicity


def test_words_of_a_small_language_are_features(spark):
    r = random.Random(6)
    large, small = (["".join(r.choice(letters) for _ in range(5)) for _ in range(800)] for letters in ("abcdefghi", "nopqrstuv"))
    rows = []
    for i in range(3000):
        vocab, vile = (small, "wwidiot") if i % 100 in (0, 1) else (large, "zzscum")
        w = [r.choice(vocab) for _ in range(30)]
        if i % 2 == 0:
            w[3:3] = [vile] * 3
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.rejected for x in toxicity.score(spark, df, labels).collect()}
    # 20 of 1000 toxic labels are of the small language
    assert [i for i in range(2000, 3000) if got[i] != (i % 2 == 0)] == []
    few = labels.filter("doc_id % 100 not in (0, 1) or doc_id < 1200")  # 12 of them
    got = {x.doc_id: x.rejected for x in toxicity.score(spark, df, few).collect()}
    assert [i for i in range(2000, 3000) if got[i] != (i % 2 == 0)] == []
