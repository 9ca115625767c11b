"""Prefix shingles that meet in passes give the components of one pass."""

import pytest

from geoshroud.llm import ngram_join


@pytest.mark.parametrize("slices", [3])
def test_passes_lose_no_link(spark, monkeypatch, slices):
    monkeypatch.setattr(ngram_join, "SLICES", slices)
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(4)]
    rows = [(100 * i + e, " ".join(w[:e] + ["edit"] * (e > 0) + w[e + 1 :] if e else w)) for i, w in enumerate(words) for e in (0, 1, 59)]
    rows += [(990, None), (991, "one two")]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d if d >= 990 else d // 100 * 100 for d, _ in rows}
