"""The corpus pipeline: every stage on its predecessor's rows, and the whole run, against brute force on a small table."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from geoshroud.llm import decontam, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _cut long, _k long, key string, v long, row long"


def rows_of(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(500)]
    passage, item = ([r.choice(vocab) for _ in range(n)] for n in (70, 30))
    texts = [None, "", " \n ", "one", "!!!"]
    for i in range(90):
        t = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        if i % 5 == 0:
            t[3:3] = passage
        if i % 9 == 0:
            t = t[:20] + item
        if i % 7 == 0:
            t[2:2] = ["vile", "slur", "scum"]
        texts.append(" ".join(t))
    for t in texts[30:60]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w)] if r.random() < 0.5 else [t, t]
    texts.append(" ".join(r.choice(vocab) for _ in range(5000)))
    rows = list(enumerate(texts))
    rows += [rows[40], (None, "no id here at all"), (None, None)]  # a repeated row, and rows without an id
    labels = [(i, int("vile" in (t or ""))) for i, t in rows if i is not None and i % 2 == 0]
    return rows, labels, [(1, " ".join(item)), (2, None), (3, "")]


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sheet"))
    rows, labels, items = rows_of()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1, 2, "b", 3, 4) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def texts_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def one_of_each(rows):
    """What is left by links of 0.8 on five-word shingles; rows that repeat id and text are one."""
    rows = list(rows)
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return {(d, t) for i, (d, t) in enumerate(rows) if d is None or not sets[i] or least[root(i)] == d}


def without_repeats(rows, n):
    rows = list(rows)
    seen = collections.Counter(b[i : i + n] for _, t in rows if t for b in [t.encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                m[j : j + n] = True
        out.append((d, None if t is None else bytes(x for x, y in zip(b, m) if not y).decode("utf-8", "ignore")))
    return collections.Counter(out)


def contaminated(t, items):
    w = [x.decode() for x in decontam.words_of((t or "").encode())]
    hit = [0] * len(w)
    for _, x in items:
        y = [z.decode() for z in decontam.words_of((x or "").encode())]
        n = min(13, len(y))
        wins = {tuple(y[i : i + n]) for i in range(len(y) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in wins:
                hit[j : j + n] = [1] * n
    return any(hit) and 20 * sum(hit) >= len(w)


def test_every_stage_and_the_run(spark, sheet):
    items = rows_of()[2]
    docs = spark.read.parquet(f"{sheet}/documents.parquet")
    names, last = [n for n, _ in corpus_pipeline.STAGES], None
    assert names == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = texts_of(docs)
        out = stage(spark, docs, sheet)
        if name == "packing":
            last = out
            break
        assert out.columns == docs.columns, name
        path = f"{sheet}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.filter("_key <> 'a' or _cut <> 1 or _k <> 2 or key <> 'b' or v <> 3 or row <> 4").isEmpty()
        got = texts_of(docs)
        if name == "toxicity":
            model = toxicity.train(spark, spark.read.parquet(f"{sheet}/documents.parquet"), spark.read.parquet(f"{sheet}/labels.parquet"))
            assert got == collections.Counter({k: n for k, n in before.items() if model.chances(k[1] and k[1].encode())[0] < 0.5})
            assert not any("vile slur scum" in (t or "") for _, t in got) and sum(got.values()) > 0.8 * sum(n for (_, t), n in before.items() if "vile" not in (t or ""))
        elif name == "jaccard_join":
            want = one_of_each(before)
            assert {k for k in got if k[0] is not None} == {k for k in want if k[0] is not None} and sum(n for (d, _), n in got.items() if d is None) == 2
        elif name == "suffix_dedup":
            assert got == without_repeats(list(before.elements()), corpus_pipeline.REPEAT_BYTES) and got != before
        else:
            assert got == collections.Counter({k: n for k, n in before.items() if not contaminated(k[1], items)}) and got != before
    pieces = last.collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:i]) for i, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sheet).select("doc_id", "start", "length", "ids_crc32").fillna(-1).collect()) == sorted(tuple(r) for r in last.select("doc_id", "start", "length", "ids_crc32").fillna(-1).collect())


def test_empty_tables(spark, sheet, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sheet}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sheet}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "decontamination"):
            assert texts_of(stage(spark, docs, str(tmp_path))) == texts_of(docs), name  # nothing to learn from, nothing to find


def test_texts_that_share_an_id_go_with_their_own_component(spark):
    from geoshroud.llm.ngram_join import keep_one

    r = random.Random(1)
    a, b, c = (" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(40)) for _ in range(3))
    rows = [(1, a, "x"), (5, a + " more", "y"), (5, b, "z"), (7, c, "w"), (7, c, "w")]
    got = keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string, _t string")).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], rows[2], rows[3]])
