"""Packing into windows of at most 4096 tokens by non-negative least squares over shallow length combinations.

Texts are cut into windows and a rest; the rests' length histogram (at most WINDOW cells, whatever the corpus) comes to the
driver.  Lengths are rounded up to cells (exact up to 64, then steps of 8).  Columns of the least-squares problem are
combinations a*x + b*y that fill a window with two cells x, y; multiplicative updates find repeat counts >= 0, they are
rounded down, and the residual histogram is packed greedily, longest first into the fullest fit.  The plan assigns ranges
of ranks within a cell to sequences; ranks come from counts by (cell, salt), so a very common length is no single task.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

WINDOW, END = 4096, 2
#: Chunks of text in one generation of a worker's memory.
MEMORY = 300_000
SALTS = 256


def cells(window: int) -> np.ndarray:
    """Upper ends of the length cells."""
    return np.array([*range(1, min(64, window) + 1), *range(72, window + 1, 8)], np.int64)


#: Chunks of printable ASCII and the letters from U+00C0 to U+00FF, without apostrophe (contractions) and ``<`` (special
#: tokens), and the parts that a SPLIT tokenizer makes of them.
_EASY = re.compile(rb"(?:[!-&(-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level alphabet: bytes that are no visible Latin-1 character stand as the characters from U+0100 on, in order.
_HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: The split rule for which _PARTS holds.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokens(dict):
    """White-space chunk (bytes) -> little-endian uint32 ids.  The tokenizer drops white space and never joins across it.

    Two generations of at most MEMORY chunks are remembered: frequent chunks move into the young one when they are met
    again.  With a tokenizer that lower-cases and splits by SPLIT, easy chunks go to its merge model directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        easy = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT}
        self.easy = _EASY.fullmatch if easy else lambda chunk: None

    def encode(self, chunk: bytes) -> bytes:
        if self.easy(chunk):
            model = self.tokenizer.model
            parts = _PARTS.findall(chunk.decode().lower())
            if not chunk.isascii():
                parts = [part.encode().decode("latin-1").translate(_HIDDEN) for part in parts]
            ids = [t.id for part in parts for t in model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_tokens: dict[str, Tokens] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None, window: int) -> DataFrame:
    """``row, doc_id, start, length, ids_crc32, doc_tokens``: windows of every document's ids and the rest."""
    small_batches(docs.sparkSession)
    end = np.asarray([END], "<u4").tobytes()

    def cut(batches):
        name = path or tokenizer_path()
        if name not in _tokens:
            _tokens[name] = Tokens(name)
        tok = _tokens[name]
        for b in batches:
            d, s, n, c, m = [], [], [], [], []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                x = tok.ids(t or b"") + end
                size = len(x) // 4
                for at in range(0, size, window):
                    part = x[4 * at : 4 * (at + window)]
                    d.append(doc), s.append(at), n.append(len(part) // 4), c.append(zlib.crc32(part)), m.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (d, s, n, c, m)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(ends: np.ndarray, window: int, have: np.ndarray):
    """Columns (x, a, y, b): a cells x and b cells y fill the window; only cells that occur; the tightest for every (x, a)."""
    at = np.flatnonzero(have)
    cols = []
    for x in at:
        for a in range(1, min(8, window // int(ends[x])) + 1):
            rest = window - a * int(ends[x])
            if rest == 0:
                cols.append((x, a, x, 0))
                continue
            fit = at[(ends[at] <= rest) & (at != x)]
            if not len(fit):
                continue
            b = np.minimum(rest // ends[fit], have[fit])
            slack = rest - b * ends[fit]
            best = np.lexsort((b, slack))[:12]
            cols += [(x, a, int(fit[i]), int(b[i])) for i in best if slack[i] <= 16]
    return np.array(cols, np.int64).reshape(-1, 4)


def nnls(cols: np.ndarray, have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts >= 0 that bring sum(counts * columns) near the histogram: multiplicative least-squares updates."""
    x, a, y, b = cols.T
    m = len(have)
    r = np.full(len(cols), have.sum() / max(1, len(cols)), float)
    want = a * have[x] + b * have[y]
    for _ in range(rounds):
        made = np.bincount(x, a * r, m) + np.bincount(y, b * r, m)
        r *= want / np.maximum(a * made[x] + b * made[y], 1e-12)
    return r


def plan(have: np.ndarray, ends: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (cell, first rank, ranks, first sequence, pieces in a sequence), and the number of sequences."""
    left, out, used, seqs = have.astype(np.int64).copy(), [], np.zeros(len(have), np.int64), 0

    def put(parts: dict[int, int], times: int) -> None:
        nonlocal seqs
        for c, k in parts.items():
            out.append((c, int(used[c]), times * k, seqs, k))
            used[c] += times * k
            left[c] -= times * k
        seqs += times

    cols = combinations(ends, window, have)
    if len(cols):
        counts = nnls(cols, have.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            x, a, y, b = map(int, cols[i])
            times = int(counts[i])
            if times < 1:
                break
            times = min(times, left[x] // a, left[y] // b if b else times)
            if times > 0:
                put({x: a, y: b} if b else {x: a}, int(times))
    while left.any():
        parts, free, c = {}, window, int(np.flatnonzero(left)[-1])
        while c >= 0:
            k = min(int(left[c]), free // int(ends[c]))
            if k:
                parts[c], free = k, free - k * int(ends[c])
            fits = np.flatnonzero(left[:c] * (ends[:c] <= free))
            c = int(fits[-1]) if len(fits) else -1
        put(parts, min(int(left[c]) // k for c, k in parts.items()))
    return out, seqs


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every row of ``docs``.

    Null and empty texts are the end id alone.  Repeated rows are packed each; a null doc_id stays null; texts of any
    length are cut at windows; other columns are ignored; an empty table gives no row.  ``path`` is the tokenizer's file
    (default: the public one on every machine).
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, path, window).withColumn("row", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    ends = cells(window)
    step = F.when(F.col("length") <= 64, F.col("length") - 1).otherwise(F.floor((F.col("length") + 7) / 8) + (64 - 8 - 1)).cast("int")
    # ranks inside (cell, salt); the salts' counts place them inside the cell
    rows = cut.withColumn("cell", step).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    counts = scratch.keep(rows.groupBy("cell", "salt").agg(F.count("*").alias("k")), "counts")
    sizes = counts.groupBy("cell").agg(F.sum("k").alias("k")).collect()  # one row for each cell
    have = np.zeros(len(ends), np.int64)
    for r in sizes:
        have[r["cell"]] = r["k"]
    table, _ = plan(have, ends, window)
    base = counts.withColumn("base", F.sum("k").over(Window.partitionBy("cell").orderBy("salt")) - F.col("k")).select("cell", "salt", "base")
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("row", "doc_id", "start")) - 1
    ranked = rows.withColumn("r", rank).join(F.broadcast(base), ["cell", "salt"]).withColumn("rank", F.col("r") + F.col("base"))
    # the plan has a few hundred rows for each cell at most, whatever the corpus
    steps = spark.createDataFrame(pd.DataFrame(table, columns=["cell", "first", "ranks", "seq", "k"]).astype("int64"), "cell long, first long, ranks long, seq long, k long") if table else spark.createDataFrame([], "cell long, first long, ranks long, seq long, k long")
    placed = ranked.join(F.broadcast(steps), (ranked["cell"] == steps["cell"]) & (ranked["rank"] >= steps["first"]) & (ranked["rank"] < steps["first"] + steps["ranks"]))
    placed = placed.withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("first")) / F.col("k")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    return out
