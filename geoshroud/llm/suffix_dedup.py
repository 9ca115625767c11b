"""Removal of long repeated byte strings by column-wise suffix sorting of aligned fragments.

A window is a string of ``n`` bytes.  Every window picks an anchor: of the k-byte grams inside it, the one of least hash
(leftmost on ties).  The pick depends on the window's bytes only, so equal windows pick equal grams at equal places;
windows of one anchor are consecutive and form a fragment of at most 2n-k bytes.  Anchors seen once are done with.
Fragments that repeat whole are covered whole.  The different fragments of one anchor are aligned on it and suffix-sorted
column by column from the right: every round inserts one symbol of every fragment, a stable sort on that symbol turns
the order of the suffixes of the last round into the new one, and the common prefix lengths follow by range minima
(the multi-string Burrows-Wheeler construction with its common-prefix array).  A window repeats exactly if its suffix
shares n bytes with a neighbour in that order.

The symbols that a round reads, in the order of the last round's suffixes, are that round's column of the transform.  One
task holds one bucket of anchors, so its columns are arrays in memory; what passes between tasks are Parquet tables and
shuffle files.  An anchor with more than MOST different fragments would be too much for a task: its fragments are taken
through the same steps again with anchors half as far from the length of a window, down to whole windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U64, _powers, mix, prefix_sums, span_hashes
from . import hashing
from .scratch import Scratch, fresh, small_batches

#: Fragments sorted together, and the most of one anchor that are (beyond, longer anchors part them).
BUCKET, MOST = 20_000, 60_000
_BITS = 20
_BLOCK = (1 << _BITS) - 4096


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = -(-len(x) // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, U64)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(x) - w + 1], left[w - 1 : len(x)])


def anchors(b: bytes, n: int, k: int):
    """(anchor, start, end, gram hash, fragment hash) arrays: fragments that hold every n-byte window of ``b`` once."""
    w, parts = n - k + 1, []
    for at in range(0, max(0, len(b) - n + 1), _BLOCK):
        a = np.frombuffer(b[at : at + _BLOCK + n - 1], np.uint8)
        c = prefix_sums(a)
        _powers(len(a) + 1)
        g = mix((c[k:] - c[:-k]) * hashing._INV[: len(a) - k + 1])
        low = U64((1 << _BITS) - 1)
        pick = (_sliding_min((g & ~low) | np.arange(len(g), dtype=U64), w) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        last = np.concatenate([first[1:], [len(pick)]]) - 1
        p = pick[first]
        h = mix(span_hashes(c, first, last + n) ^ (p - first).astype(U64))
        parts.append((p + at, first + at, last + n + at, g[p].view(np.int64), h.view(np.int64)))
    if not parts:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*parts))


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]) (inclusive) by a sparse table as deep as the longest range."""
    size = hi - lo + 1
    level = np.frombuffer(np.log2(size).astype(np.int64).tobytes(), np.int64) if len(size) else size
    out, table, step = np.empty(len(lo), x.dtype), x, 0
    top = int(level.max(initial=0))
    while True:
        m = level == step
        if m.any():
            out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << step) + 1])
        if step == top:
            return out
        table = np.minimum(table[: -(1 << step)], table[1 << step :])
        step += 1


def repeated_windows(frags: list[bytes], offs: list[int], n: int, k: int) -> np.ndarray:
    """Boolean (fragments x columns): the n-byte window at that column also occurs, at that column, in another fragment.

    Columns are counted from n-k before the anchor.
    """
    left = n - k
    m, width = len(frags), left + n
    text = np.full((m, width), 256, np.int16)
    for i, (f, o) in enumerate(zip(frags, offs)):
        text[i, left - o : left - o + len(f)] = np.frombuffer(f, np.uint8)
    text = np.ascontiguousarray(text.T)
    order, lcp = np.arange(m), np.zeros(m, np.int16)
    found = np.zeros((left + 1, m), bool)
    for x in range(width - 1, -1, -1):
        sym = text[x][order]
        perm = np.argsort(sym, kind="stable")
        order, sym = order[perm], sym[perm]
        new = np.zeros(m, np.int16)
        j = np.flatnonzero((sym[1:] == sym[:-1]) & (sym[1:] < 256)) + 1
        p, q = perm[j - 1], perm[j]
        near = q == p + 1
        new[j[near]] = lcp[q[near]] + 1
        far = ~near
        if far.any():
            new[j[far]] = _range_min(lcp, p[far] + 1, q[far]) + 1
        lcp = new
        if x <= left:
            hit = lcp >= n
            hit[:-1] |= hit[1:]
            # hit[j] or hit[j+1]: the row shares n bytes with the row before or after it
            found[x][order] = hit
    return found.T


def _spans(found: np.ndarray, left: int, n: int):
    """Maximal runs of True by row, as [lo, hi) byte spans relative to the anchor."""
    pad = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    pad[:, 1:-1] = found
    d = np.diff(pad, axis=1)
    r, s = np.nonzero(d == 1)
    _, e = np.nonzero(d == -1)
    return r, s - left, e - 1 + n - left


def _key(*columns: str) -> Column:
    """128 bits that name a row of text."""
    return F.struct(F.xxhash64(*columns).alias("hi"), F.xxhash64(F.lit(7), *reversed(columns)).alias("lo"))


def _repeats(spark: SparkSession, keyed: DataFrame, n: int, k: int, scratch: Scratch) -> DataFrame:
    """``key, cut array<struct<lo,hi>>``: the byte spans of repeated n-byte strings of every text (``key, text``) that has any."""

    def find(batches):
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if t is None or len(t) < n:
                    continue
                p, s, e, g, h = anchors(t, n, k)
                key = pa.StructArray.from_arrays([pa.array(np.full(len(p), key[c])) for c in ("hi", "lo")], ["hi", "lo"])
                yield pa.RecordBatch.from_arrays([key, pa.array(p), pa.array(s), pa.array(e), pa.array(g), pa.array(h)], ["key", "a", "s", "e", "ah", "fk"])

    def find_packed(batches):
        held, rows = [], 0
        for x in find(batches):
            held.append(x)
            rows += x.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    marks = scratch.keep(keyed.mapInArrow(find_packed, "key struct<hi:long,lo:long>, a long, s long, e long, ah long, fk long"), "anchors")
    multi = scratch.keep(marks.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah"), "multi")
    again = scratch.keep(marks.join(multi, "ah"), "again")
    scratch.drop(marks, multi)
    kinds = scratch.keep(again.groupBy("ah", "fk").agg(F.count("*").alias("c"), F.min(F.struct("key", "s", "e", "a")).alias("one")), "kinds")
    crowd = kinds.groupBy("ah").agg(F.count("*").alias("nf")).filter("nf > 1")
    # a fragment that repeats whole needs no sorting itself, but others may share windows with it
    odd = scratch.keep(kinds.join(crowd, "ah").select("ah", "fk", "nf", "c", "one.*"), "odd")
    n_odd = odd.count()
    place = odd.groupBy("key").agg(F.collect_list(F.struct("ah", "fk", "nf", "c", "s", "e", "a")).alias("want"))

    def cut(batches):
        for b in batches:
            out = {c: [] for c in ("ah", "fk", "nf", "c", "o", "frag")}
            for t, want in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("want").to_pylist()):
                for w in want:
                    for c in ("ah", "fk", "nf", "c"):
                        out[c].append(w[c])
                    out["o"].append(w["a"] - w["s"])
                    out["frag"].append(t[w["s"] : w["e"]])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "frag" else pa.int64()) for c, v in out.items()], list(out))

    frags = keyed.join(place.hint("merge"), "key").select("text", "want").mapInArrow(cut, "ah long, fk long, nf long, c long, o long, frag binary").dropDuplicates(["ah", "fk"])
    frags = scratch.keep(frags, "fragments")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_odd // BUCKET))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        left = n - k
        found = repeated_windows(pdf["frag"].tolist(), pdf["o"].tolist(), n, k)
        r, lo, hi = _spans(found, left, n)
        return pd.DataFrame({"ah": pdf["ah"].to_numpy()[r], "fk": pdf["fk"].to_numpy()[r], "lo": lo, "hi": hi})

    spans = frags.filter(F.col("nf") <= MOST).withColumn("bucket", F.pmod(F.xxhash64("ah"), F.lit(buckets))).groupBy("bucket").applyInPandas(sort, "ah long, fk long, lo long, hi long")
    crowded = frags.filter(F.col("nf") > MOST)
    if not crowded.isEmpty():  # longer anchors tell these fragments apart
        longer = n if n - k < n // 8 + 2 else k + (n - k) // 2
        inner = _repeats(spark, crowded.select(F.struct(F.col("ah").alias("hi"), F.col("fk").alias("lo")).alias("key"), F.col("frag").alias("text")), n, longer, scratch)
        inner = inner.select(F.col("key.hi").alias("ah"), F.col("key.lo").alias("fk"), F.explode("cut").alias("x")).join(crowded.select("ah", "fk", "o").hint("merge"), ["ah", "fk"])
        spans = spans.union(inner.select("ah", "fk", (F.col("x.lo") - F.col("o")).alias("lo"), (F.col("x.hi") - F.col("o")).alias("hi")))
    whole = kinds.filter("c > 1").select("ah", "fk", (F.col("one.s") - F.col("one.a")).alias("lo"), (F.col("one.e") - F.col("one.a")).alias("hi"))
    spans = scratch.keep(spans.union(whole), "spans")
    cover = again.join(spans, ["ah", "fk"]).select("key", (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))
    out = scratch.keep(cover.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("cut")), "cut")
    scratch.drop(again, kinds, odd, frags, spans)
    return out


def repeats(spark: SparkSession, docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``key, cut``: the repeated spans of every text that has any; ``key`` is ``_key("doc_id", "text")``."""
    return _repeats(spark, docs.select(_key("doc_id", "text").alias("key"), "text"), n, max(1, n // 4), scratch)


def _longer(spark: SparkSession, keyed: DataFrame, cuts: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``key, cut`` for windows of ``n`` bytes from the ``cuts`` of shorter ones.

    A string that repeats has only repeated strings inside, so both of its places lie in runs that were cut: the search
    over these runs in place of the texts loses none.
    """

    def pieces(batches):
        for b in batches:
            out = {c: [] for c in ("hi", "lo", "at", "text")}
            for key, t, cut in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("cut").to_pylist()):
                for lo, hi in merged(cut):
                    if hi - lo >= n:
                        out["hi"].append(key["hi"]), out["lo"].append(key["lo"]), out["at"].append(lo), out["text"].append(t[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "text" else pa.int64()) for c, v in out.items()], list(out))

    runs = keyed.join(cuts.hint("merge"), "key").mapInArrow(pieces, "hi long, lo long, at long, text binary")
    runs = scratch.keep(runs.select(_key("hi", "lo", "at").alias("key"), F.struct("hi", "lo").alias("of"), "at", "text"), "runs")
    inner = _repeats(spark, runs.select("key", "text"), n, max(1, n // 4), scratch)
    x = inner.select("key", F.explode("cut").alias("x")).join(runs.select("key", "of", "at").distinct().hint("merge"), "key")
    out = x.groupBy(F.col("of").alias("key")).agg(F.collect_set(F.struct((F.col("x.lo") + F.col("at")).alias("lo"), (F.col("x.hi") + F.col("at")).alias("hi"))).alias("cut"))
    out = scratch.keep(out, "longer")
    scratch.drop(runs, inner)
    return out


def merged(cut: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    out: list[list[int]] = []
    for lo, hi in sorted((c["lo"], c["hi"]) for c in cut or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def dedup_spans(spark: SparkSession, docs: DataFrame, n: int = 400, with_text: bool = False, text_n: int | None = None) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with what is left of its bytes.

    A byte goes if some n-byte string that covers it starts at another place too, in any row's text, its own included.
    Columns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``text``: the remaining text (the bytes
    of a character cut in two are left out there; null stays null).  With ``text_n`` (at most n), ``text`` is what strings of
    ``text_n`` bytes leave, as in ``without_repeats``; the other columns hold for n.  Null texts count as empty; texts of fewer than n
    bytes lose nothing; repeated rows are repeats of each other; other columns are ignored; an empty table gives no row.
    """
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    short = text_n if with_text and text_n and text_n < n else n
    keyed = docs.select("doc_id", "text", _key("doc_id", "text").alias("key"))
    cuts = repeats(spark, docs, short, scratch)
    if short < n:
        long = _longer(spark, keyed.select("key", "text"), cuts, n, scratch)
        cuts = cuts.withColumnRenamed("cut", "short").join(long.hint("merge"), "key", "left")
    else:
        cuts = cuts.withColumn("short", F.col("cut"))
    rows = keyed.join(cuts, "key", "left").select("doc_id", "text", "cut", "short")

    def without(x: bytes, spans: list[tuple[int, int]]) -> bytes:
        left, at = [], 0
        for lo, hi in spans:
            left.append(x[at:lo])
            at = hi
        return b"".join([*left, x[at:]]) if spans else x

    def apply(batches):
        for b in batches:
            nb, nr, ns, sha, kept = [], [], [], [], []
            for t, cut, more in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("cut").to_pylist(), b.column("short").to_pylist()):
                spans, x = merged(cut), t or b""
                rest = without(x, spans)
                nb.append(len(x)), nr.append(len(x) - len(rest)), ns.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(None if t is None else (without(x, merged(more)) if short < n else rest).decode("utf-8", "ignore"))
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array(v, pa.int64()) for v in (nb, nr, ns)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string())] if with_text else cols, [*names, "text"] if with_text else names)

    return rows.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)


def without_repeats(spark: SparkSession, docs: DataFrame, n: int = 400) -> DataFrame:
    """``docs`` with its repeated strings cut out of ``text`` and ``n_chars`` (if there) set to the new length.

    Only texts that lose bytes change; all rows and columns stay, whatever their names.
    """
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    cuts = repeats(spark, docs, n, scratch)
    key, cut = fresh(docs, "key"), fresh(docs, "cut")
    rows = docs.withColumn(key, _key("doc_id", "text")).join(cuts.select(F.col("key").alias(key), F.col("cut").alias(cut)), key, "left")

    @F.pandas_udf("string")
    def rest(text: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cut):
            if t is not None and c is not None:
                x, at, left = t.encode(), 0, []
                for lo, hi in merged([{"lo": s["lo"], "hi": s["hi"]} for s in c]):
                    left.append(x[at:lo])
                    at = hi
                t = b"".join([*left, x[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    out = rows.withColumn("text", rest("text", cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
