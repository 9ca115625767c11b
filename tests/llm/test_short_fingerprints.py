"""Texts of about K tokens: each has a fingerprint of its own."""

from __future__ import annotations

import random

from geoshroud.llm import fingerprints


def test_no_text_with_tokens_is_without_anchor(spark):
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(4 + i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.fingerprints(spark, df).collect()}
    assert all(got[i].fingerprint for i in range(400))
    assert len({got[i].fingerprint for i in range(400)}) == 400 and all(got[i].near_next < 1 for i in range(400))
