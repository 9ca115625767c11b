"""Anchors against brute force: which k-mers are chosen, context freedom, likeness."""

from __future__ import annotations

import random

import pytest
import regex
from pyspark.sql import functions as F

from geoshroud.llm import fingerprints as fp

LONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def lists(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.a for r in fp.with_anchors(df, "t", "a").orderBy("i").collect()]


def words(seed, n, size=(1, 8)):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgé") for _ in range(r.randint(*size))) for _ in range(n)]


@pytest.mark.parametrize("after", ["x" * 4000, "　 日本語" * 30, " , , ,", "\n\n\tA b", "w" * 17 + " and more of it"])
def test_appending_keeps_every_anchor(spark, after):
    for base in ([w + "," for w in words(1, 60)], words(2, 80, (17, 30)), list("日本語のテキストは空白がない"), words(3, 9)):
        one, more = lists(spark, [" ".join(base), " ".join(base) + " " + after])
        assert more[: len(one)] == one and one


def test_white_space_and_signs_do_not_matter(spark):
    w = words(5, 50)
    a = lists(spark, [" ".join(w), "  ".join(w), " ".join(w), " \r\n".join(w), ", ".join(w).upper(), "-".join(w)])
    assert all(x == a[0] for x in a) and len(a[0]) > 10


def test_chosen_by_brute_force(spark):
    texts = [" ".join(words(s, s)) for s in range(5, 60, 3)]
    pattern = regex.compile(rf"[{LONE}]|[\p{{L}}\p{{N}}\p{{M}}--[{LONE}]]{{1,16}}", regex.V1)
    got = lists(spark, texts)
    for t, a in zip(texts, got):
        tok = pattern.findall(t.lower())
        rows = [(i, *tok[i : i + fp.S]) for i in range(len(tok) - fp.S + 1)]
        s = [r[0] for r in spark.createDataFrame(rows, "i int, a string, b string").orderBy("i").select(F.xxhash64("a", "b")).collect()]
        at = [i for i in range(len(tok) - fp.K + 1) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]
        assert not at or len(a) == len({(s[i], s[i + 2], s[i + 3]) for i in at})


def test_likeness_by_brute_force(spark):
    r = random.Random(9)
    rows = [([], []), ([1], []), ([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [3, 2, 1]), ([-1, 2, -3, 4], [9, -1, 2, 8, -3])]
    for _ in range(60):
        a = r.sample(range(-20, 20), r.randint(0, 20))
        rows.append((a, sorted(r.sample(range(-20, 20), r.randint(0, 20)), key=lambda x: (a.index(x) if x in a else 50, x)) if r.random() < 0.5 else r.sample(range(-20, 20), 12)))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<int>, b array<int>").select("i", fp.likeness("a", "b").alias("l"))
    for (a, b), got in zip(rows, df.orderBy("i").collect()):
        here, there = [x for x in a if x in b], [x for x in b if x in a]
        follow = len(set(zip(here, here[1:])) & set(zip(there, there[1:])))
        union = len(set(a) | set(b))
        assert got.l == pytest.approx(1.0 if not union else 0.0 if not here else (follow + 1) / union)
