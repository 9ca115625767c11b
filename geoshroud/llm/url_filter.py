"""URL filter: path rules on hosts, and naive Bayes over segmented names for the rest.

Host labels are names run together ("thedailynews").  Unigram counts come from all page titles and from letters in url
paths, words of any length; every run of letters in a host is split by the unigram Viterbi path over its substrings that are
known words (others pay by length), runs of digits are tokens as they are.  Labels are deduplicated first, and only the counts
of their substrings are joined, so no vocabulary is held anywhere.  Multinomial naive Bayes is fitted on all urls that a rule
judges, on the tokens of whole hosts and whole paths (hashed, so its table has a fixed size), and judges the others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Cells of the naive Bayes table (two classes each): 2 MB of doubles, whatever the input.
CELLS = 1 << 17


def host_of(url: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOW)


def path_of(url: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules=None) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split into words; an unknown word of n letters has probability 10/(total * 10**n).  Ties: the longer
    last word.

    Known words are tried by their lengths; of unknown last words only the best start matters, which is carried along, so a
    label costs its length times the number of different lengths.
    """
    n, lt, ten = len(label), math.log(max(total, 1)), math.log(10)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    sizes = sorted({len(w) for w in counts}, reverse=True)
    start, at = 0.0, 0  # the best of best[s] + s log 10, and its s
    for e in range(1, n + 1):
        best[e], back[e] = start - e * ten + ten - lt, at
        for k in sizes:
            c = counts.get(label[e - k : e]) if k <= e else None
            if c:
                p = best[e - k] + math.log(c) - lt
                if p > best[e] + 1e-9 or p > best[e] - 1e-9 and e - k < back[e]:
                    best[e], back[e] = p, e - k
        if best[e] + e * ten > start + 1e-9:
            start, at = best[e] + e * ten, e
    out, e = [], n
    while e:
        out.append(label[back[e] : e])
        e = back[e]
    return out[::-1]


def _unigrams(pages: DataFrame) -> DataFrame:
    title = F.expr("substring(html, instr(html, '<title>') + 7, greatest(0, instr(html, '</title>') - instr(html, '<title>') - 7))")
    text = F.concat_ws(" ", F.when(F.instr("html", "<title>") > 0, title), F.col("path")) if "html" in pages.columns else F.col("path")
    words = F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")
    return pages.select(words).filter(F.length("w") > 0).groupBy("w").agg(F.count("*").alias("c"))


def segments(spark: SparkSession, labels: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``label, words`` for the distinct labels; label parts of letters are split, the rest stays."""
    total = unigrams.agg(F.sum("c").alias("n")).first()["n"] or 1
    sizes = sorted(r["k"] for r in unigrams.select(F.length("w").alias("k")).distinct().collect())  # different lengths of words
    n = F.length("label")
    sub = labels.select("label", F.explode(F.filter(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"), lambda k: k <= n)).alias("k"))
    sub = sub.select("label", "k", F.explode(F.sequence(F.lit(1), n - F.col("k") + 1)).alias("i")).select("label", F.expr("substring(label, i, k)").alias("w"))
    known = sub.distinct().join(unigrams, "w").groupBy("label").agg(F.collect_list(F.struct("w", "c")).alias("known"))  # at most a label's substrings

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, {r["w"]: r["c"] for r in (k if k is not None else [])}, total) for x, k in zip(label, known)], dtype=object)

    return labels.join(known, "label", "left").select("label", split("label", "known").alias("words"))


def judge(spark: SparkSession, pages: DataFrame, rules=None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; score is the log odds of block where no rule fits, else null.

    Null urls and urls without ``://`` have empty host and path, no rule, and the verdict of the priors.  Repeated rows
    have equal results; other columns than page_id, url and html are ignored; without urls judged by rules, or with only
    one class of them, the method allows unless that class is block; an empty table gives no row.
    """
    scratch = Scratch(spark, "urls")
    base = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), *(["html"] if "html" in pages.columns else []))
    name, verdict = rule_of("host", "path", rules)
    slim = scratch.keep(base.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).withColumn("rule", name).withColumn("ruled", verdict), "urls")
    parts = slim.select("host").distinct().select("host", F.explode(F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("run"))
    parts = parts.select("host", F.explode(F.regexp_extract_all("run", F.lit(r"\p{L}+|\p{N}+"), F.lit(0))).alias("label"))
    parts = scratch.keep(parts.distinct(), "labels")
    words = scratch.keep(segments(spark, parts.filter(F.col("label").rlike(r"^\p{L}")).select("label").distinct(), _unigrams(base)), "segments")
    digits = parts.filter(~F.col("label").rlike(r"^\p{L}")).select("host", F.col("label").alias("w"))
    hosts = parts.join(words, "label").select("host", F.explode("words").alias("w")).union(digits).groupBy("host").agg(F.array_sort(F.collect_list("w")).alias("words"))
    hosts = scratch.keep(hosts, "hosts")
    kinds = slim.groupBy("host", "path", "ruled").agg(F.count("*").alias("k"))
    kinds = scratch.keep(kinds.join(hosts, "host", "left"), "kinds")
    cell = lambda t: F.pmod(F.xxhash64(t), F.lit(CELLS)).cast("int")
    inpath = F.transform(F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))
    inhost = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("."), x))
    kinds = kinds.withColumn("cells", F.transform(F.concat(inhost, inpath), cell))
    ruled = kinds.filter("ruled is not null")
    prior = {r["ruled"]: r["k"] for r in ruled.groupBy("ruled").agg(F.sum("k").alias("k")).collect()}
    counts = ruled.select("ruled", "k", F.explode("cells").alias("cell")).groupBy("ruled", "cell").agg(F.sum("k").alias("k")).collect()  # at most 2 * CELLS rows
    table = np.ones((2, CELLS))
    for r in counts:
        table[int(r["ruled"] == "block"), r["cell"]] += r["k"]
    weights = np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())
    bias = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1))
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def odds(cells: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([bias + float(w[np.asarray(c, np.int64)].sum()) for c in cells])

    open_ = kinds.filter("ruled is null").select("host", "path", F.round(odds("cells"), 6).alias("score"))
    open_ = scratch.keep(open_, "scores")
    out = slim.join(open_, ["host", "path"], "left")
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
