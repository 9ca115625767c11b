"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; each bit has a binary n-gram classifier (smoothed log odds of the n-grams of the languages
with a 1 against those with a 0).  A text's margin for a bit is the mean log odds of its n-grams; decoding takes the
codeword of least loss, the bits' losses weighted by how well each bit separates the training texts.  A text whose two best
codewords are close is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import LOWER
from .scratch import small_batches

CELLS = 1 << 15
#: About so many training texts of each language are used at most; which ones depends on the hash of doc_id alone.
MAX_TEXTS = 4000
#: A language's codeword has at most so many bits; up to 5 languages all distinct splits are used.
MAX_BITS = 31
CLOSE = 0.1
_LETTER = re.compile(r"[^\W\d_]")


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def grams(text: bytes) -> np.ndarray:
    """Hashed byte 1-, 2-, 3- and 4-grams of the lower-cased text."""
    a = np.frombuffer(b" " + text.translate(LOWER) + b" ", np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(a), np.uint32)
    for j in range(4):
        if len(a) <= j:
            break
        h = h[: len(a) - j] * np.uint32(257) + a[j:] + np.uint32(1)
        out.append(((h * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) & (CELLS - 1) if j else a.astype(np.int64))
    return np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """(languages x bits) of -1/+1: every split of few languages, else pseudo-random splits of many, all rows distinct."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    rng = np.random.Generator(np.random.PCG64(7))
    width = max(MAX_BITS, 2 * int(np.ceil(np.log2(n))) + 1)
    while True:
        code = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        if len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all():
            return code


def train(spark: SparkSession, docs: DataFrame):
    """Languages, codewords, the n-gram weights of each bit and the bits' weights."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return langs, None, None, None
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, MAX_TEXTS / sizes[k]))])
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    small_batches(spark)

    def count(batches):
        table = {}
        for b in batches:
            for x, t in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                c = table.setdefault(x, np.zeros(CELLS))
                c += np.bincount(grams(t), minlength=CELLS)
        for x, c in table.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], ["lang", "cell", "n"])

    counts = np.zeros((len(langs), CELLS))
    got = some.select("lang", "text").mapInArrow(count, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS a language
    np.add.at(counts, (got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["cell"].to_numpy()), got["n"].to_numpy())
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((code.shape[1], CELLS))
    for j in range(code.shape[1]):
        one, zero = p[code[:, j] > 0].mean(0), p[code[:, j] < 0]
        weights[j] = np.log(one) - np.log(zero.mean(0)) if len(zero) else 1.0
    margins = p @ weights.T  # mean log odds of each language's own n-grams
    trust = np.maximum((margins * code).min(0), 0.05)
    return langs, code, weights, trust / trust.sum() * len(trust)


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Shares of the codewords: softmax of minus the weighted logistic losses, scaled to count as 8 bits."""
    loss = (np.logaddexp(0, -8 * code * margins) * trust).sum(1) * 8 / len(trust)
    e = np.exp(loss.min() - loss)
    return e / e.sum()


def predict(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Only rows that are not held out teach.  Null texts and texts without a letter are ``und`` with score 0; so is every
    text if nothing was learned.  A null doc_id counts as not held out.  Repeated rows have equal results (whole texts
    count, of any length); other columns are ignored; an empty table gives no row.
    """
    langs, code, weights, trust = train(spark, docs)
    model = spark.sparkContext.broadcast((langs, code, weights, trust))
    small_batches(spark)

    def run(batches):
        langs, code, weights, trust = model.value
        for b in batches:
            pred, score, close = [], [], []
            for t in b.column("text").to_pylist():
                if t is None or not langs or not _LETTER.search(t):
                    pred.append("und"), score.append(0.0), close.append(True)
                    continue
                g = np.bincount(grams(t.encode()), minlength=CELLS)
                p = decode(weights @ g / g.sum(), code, trust)
                o = np.argsort(-p, kind="stable")
                pred.append(langs[o[0]]), score.append(float(p[o[0]]))
                close.append(len(o) > 1 and bool(p[o[0]] - p[o[1]] < CLOSE))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
