"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed words and their first five and four letters.  Grades are 0 for texts labelled clean and, for texts
labelled toxic, 1 to GRADES-1 by the number of words that toxic texts have and clean ones lack (cut at quantiles of the
training texts).  One weight vector serves all thresholds: P(grade > j) = sigmoid(w.x - theta_j), theta ascending; the
output is the expected grade and the chance of any toxicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import LOWER, mix, pieces, prefix_sums, span_hashes, spans
from .scratch import small_batches

GRADES = 4
CELLS = 1 << 22
#: A feature is in at least MIN_TEXTS toxic training texts, MIN_RATE times as often as in clean ones, and its likelihood
#: ratio against one rate for both is at least MIN_G2 (chance 0.001).  None of these grows with the labels, so words of a
#: small language or source count however many other labels there are.
MIN_TEXTS, MIN_RATE, MIN_G2 = 3, 10, 10.83
#: About so many labelled texts of each class are used to fit at most; which ones depends on the hash of doc_id alone.
MAX_TEXTS = 20_000
_GAP = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Cells of all words and word starts (with repeats), and the number of words."""
    out, n = [], 0
    for part in pieces(text.translate(LOWER), _GAP):
        a = np.frombuffer(part, np.uint8)
        s, e = spans(a, _GAP)
        if not len(s):
            continue
        n += len(s)
        c = prefix_sums(a)
        for kind, size in ((1, None), (2, 5), (3, 4)):
            lo, hi = s, e
            if size:
                long = e - s > size
                lo, hi = s[long], s[long] + size
            out.append((mix(span_hashes(c, lo, hi) + np.uint64(kind)) & np.uint64(CELLS - 1)).astype(np.int64))
    return (np.concatenate(out) if out else np.empty(0, np.int64)), n


class Model:
    """Sorted feature cells, shared weights and ascending thresholds."""

    def __init__(self, cells: np.ndarray, w: np.ndarray, theta: np.ndarray):
        self.cells, self.w, self.theta = cells, w, theta

    def chances(self, text: bytes | None) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        if not len(self.cells) or not text:
            return np.zeros(len(self.theta))
        x = row(features(text)[0], self.cells)
        return 1 / (1 + np.exp(np.clip(self.theta - self.w[x[0]] @ x[1], -60, 60)))


def row(f: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``cells`` and values log(1+count) of a text's features."""
    at = np.searchsorted(cells, f)
    at[at == len(cells)] = 0
    at = at[cells[at] == f]
    i, c = np.unique(at, return_counts=True)
    return i, np.log1p(c)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, width: int, rounds: int = 500, l2: float = 1e-4):
    """Proportional-odds fit by gradient descent with momentum; thresholds are a first value and positive steps."""
    n, k = len(rows), GRADES - 1
    doc = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    col = np.concatenate([i for i, _ in rows]) if n else np.empty(0, np.int64)
    val = np.concatenate([v for _, v in rows]) if n else np.empty(0)
    above = (grade[:, None] > np.arange(k)).astype(float)
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))[:, None]
    w, first, step = np.zeros(width), 1.0, np.zeros(k - 1)
    m = [np.zeros(width), 0.0, np.zeros(k - 1)]
    v = [np.zeros(width), 0.0, np.zeros(k - 1)]
    for t in range(1, rounds + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(step))])
        z = np.bincount(doc, val * w[col], n)
        g = weight * (1 / (1 + np.exp(np.clip(theta - z[:, None], -60, 60))) - above)
        gt = -g.sum(0)
        grads = [np.bincount(col, val * g.sum(1)[doc], width) + l2 * w / max(1, width), gt.sum(), np.exp(step) * gt[::-1].cumsum()[::-1][1:]]
        new = []
        for i, (p, d) in enumerate(zip((w, first, step), grads)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            new.append(p - 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8))
        w, first, step = new
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(step))])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows of ``docs``."""
    small_batches(spark)
    # a doc_id labelled twice counts as toxic if one label says so
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, min(1.0, MAX_TEXTS / max(1, sizes.get(1, 0)))).otherwise(min(1.0, MAX_TEXTS / max(1, sizes.get(0, 0))))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)  # at most about 2 * MAX_TEXTS rows
    some = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(marks), "doc_id")

    def count(batches):
        table = [{}, {}]
        for b in batches:
            for x, t in zip(b.column("toxic").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                for f in np.unique(features(t)[0]).tolist():
                    table[x > 0][f] = table[x > 0].get(f, 0) + 1
        for x in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(table[x]), pa.int64()), pa.array([v * x for v in table[x].values()], pa.int64()), pa.array([v * (1 - x) for v in table[x].values()], pa.int64())], ["cell", "bad", "good"])

    df = some.select("toxic", "text").mapInArrow(count, "cell long, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # texts repeat; a feature needs a few toxic texts, and a rate well above that in clean ones; as the training texts are
    # bounded by MAX_TEXTS, so are the features, and none is left out for others
    nb, ng = max(1, min(sizes.get(1, 0), MAX_TEXTS)), max(1, min(sizes.get(0, 0), MAX_TEXTS))
    rate = (F.col("bad") + 0.5) / nb / ((F.col("good") + 0.5) / ng)
    seen = F.col("bad") + F.col("good")
    g2 = 2 * (F.col("bad") * F.log(F.col("bad") * (nb + ng) / (seen * nb)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") * (nb + ng) / (seen * ng))).otherwise(0.0))
    best = df.filter(F.col("bad") >= MIN_TEXTS).filter(rate > MIN_RATE).filter(g2 >= MIN_G2).select("cell", "good", "bad").toPandas()
    cells = np.sort(best["cell"].to_numpy(np.int64))
    pure = np.sort(best.loc[best["good"] * nb * 20 <= best["bad"] * ng, "cell"].to_numpy(np.int64))
    if not len(cells):
        return Model(cells, np.empty(0), np.zeros(GRADES - 1))
    known = spark.sparkContext.broadcast((cells, pure))

    def rows(batches):
        cells, pure = known.value
        for b in batches:
            at, val, many = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                f, _ = features(t)
                i, v = row(f, cells)
                at.append(i), val.append(v), many.append(float(np.isin(f, pure).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic").cast(pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(val, pa.list_(pa.float64())), pa.array(many)], ["doc_id", "toxic", "at", "val", "many"])

    got = some.select("doc_id", "toxic", "text").mapInArrow(rows, "doc_id long, toxic long, at array<long>, val array<double>, many double").toPandas().sort_values(["doc_id", "many"])
    bad, many = got["toxic"].to_numpy() > 0, got["many"].to_numpy()
    grade = np.zeros(len(got), np.int64)
    if bad.any():
        cuts = np.quantile(many[bad], np.arange(1, GRADES - 1) / (GRADES - 1))
        grade[bad] = 1 + np.searchsorted(cuts, many[bad])
    w, theta = fit([(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(got["at"], got["val"])], grade, len(cells))
    return Model(cells, w, theta)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, toxic_chance, grade, rejected`` for every row of ``docs``.

    severity is the expected grade (0 to GRADES-1), grade the likeliest one, toxic_chance = P(grade > 0); a text is rejected
    when that is at least 0.5.  Null and empty texts score 0, and so does every text if no label is toxic.  Repeated rows
    have equal results; labels without a text, or null, are passed over; other columns are ignored; an empty table gives
    no row.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    def run(batches):
        m = model.value
        for b in batches:
            c = np.array([m.chances(t) for t in b.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, GRADES - 1)
            p = np.concatenate([1 - c[:, :1], c[:, :-1] - c[:, 1:], c[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(c.sum(1).round(6)), pa.array(c[:, 0].round(6)), pa.array(p.argmax(1).astype(np.int64)), pa.array(c[:, 0] >= 0.5)], ["doc_id", "severity", "toxic_chance", "grade", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, toxic_chance double, grade long, rejected boolean")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model, at = spark.sparkContext.broadcast(train(spark, docs, labels)), docs.columns.index("text")

    def keep(batches):
        m = model.value
        for b in batches:
            yield b.filter(pa.array([bool(m.chances(t)[0] < 0.5) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
