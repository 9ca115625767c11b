"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, each text scanned once.

Words are ASCII letters and digits (A-Z lower-cased) and all non-ASCII characters.  The automaton's symbols are numbers of
words that occur in the items, its patterns windows of W words in a row (an item of fewer words is one window).  A match
ends at a word; normalising keeps the length of every text in bytes, so a hit's words map back to [start, end) byte offsets
of the original text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, small_batches

W = 13
#: Bytes of item text in one automaton; a larger benchmark is scanned in several blocks of items, each whole.
BLOCK_BYTES = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Matcher:
    """The automaton of a list of (item_id, text bytes); null and wordless items have no window."""

    def __init__(self, items: list[tuple[int, bytes | None]], width: int = W):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text or b"")]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.found = [(len(p), frozenset(v)) for p, v in windows.items()]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(windows):
            self.auto.add_word(p, i)
        if windows:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [lo, hi) of the occurrences, in order of their ends, and the items that occur."""
        if not self.found:
            return [], set()
        get = self.number.get
        seq = tuple([get(w, 0) for w in words])
        spans, items = [], set()
        for end, i in self.auto.iter(seq):
            size, who = self.found[i]
            spans.append((end + 1 - size, end + 1))
            items |= who
        return spans, items


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the words inside the union of spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of words inside the union of spans."""
    return sum(hi - lo for lo, hi in runs(spans))


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans as byte offsets of the original text."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_LOWER))] if spans else []
    return [{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in spans]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_matchers: dict = {}


def _scan(docs: DataFrame, items: list[tuple[int, bytes | None]], width: int, key: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(items), hashlib.sha256(repr((width, items)).encode()).hexdigest()

    def scan(batches):
        if name not in _matchers:
            _matchers.clear()
            _matchers[name] = Matcher(shared.value, width)
        m = _matchers[name]
        for b in batches:
            out = {c: [] for c in ("n_words", "lo", "hi", "ids", "spans")}
            for t in b.column("text").cast(pa.binary()).to_pylist():
                w = words_of(t or b"")
                spans, who = m.scan(w)
                spans = runs(spans)
                for c, x in zip(out, (len(w), [s for s, _ in spans], [e for _, e in spans], sorted({str(x) for x in who}), offsets(t, spans) if spans else [])):
                    out[c].append(x)
            first = {"key": b.column("key")} if key else {}
            cols = first | {"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": pa.array(out["n_words"], pa.int64())}
            if key:
                cols |= {c: pa.array(out[c], pa.list_(pa.int64())) for c in ("lo", "hi")}
            else:
                cols["n_hit"] = pa.array([sum(y) - sum(x) for x, y in zip(out["lo"], out["hi"])], pa.int64())
            cols |= {"ids": pa.array(out["ids"], pa.list_(pa.string())), "spans": pa.array(out["spans"], _SPANS)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    places = "spans array<struct<start:long,end:long>>"
    if key:
        return docs.mapInArrow(scan, f"key long, doc_id long, n_words long, lo array<long>, hi array<long>, ids array<string>, {places}")
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, n_words long, n_hit long, ids array<string>, {places}")


def _blocks(items: DataFrame) -> list:
    """Filters that part the items into blocks of about BLOCK_BYTES."""
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = int(-(-size // BLOCK_BYTES)) or 1
    return [F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i for i in range(n)]


def _items(items: DataFrame, block) -> list[tuple[int, bytes | None]]:
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull() & block).select("item_id", "text").collect()  # one block
    return sorted((r["item_id"], r["text"].encode()) for r in rows)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = W) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every row of ``docs``.

    ``spans`` holds the maximal runs of hit words as [start, end) byte offsets of the original UTF-8 text.  A text is contaminated when n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts have no words; items without id
    or text are passed over; repeated items count once for an id; repeated rows have equal results; other columns are
    ignored; an empty benchmark finds nothing, an empty table gives no row.  A benchmark of more than BLOCK_BYTES is scanned
    block by block, and the spans of a text are merged over the blocks.
    """
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        out = _scan(docs, _items(benchmark, blocks[0]), width, False)
    else:
        scratch = Scratch(spark, "decontam")
        keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
        keyed = scratch.keep(keyed, "rows")
        parts = None
        for block in blocks:
            one = scratch.keep(_scan(keyed, _items(benchmark, block), width, True), "block")
            parts = one if parts is None else parts.unionByName(one)

        def merge(batches):
            for b in batches:
                rows = [{"n_hit": 0, "ids": [], "spans": []} for _ in range(b.num_rows)]
                for row, lo, hi, ids, spans in zip(rows, *(b.column(c).to_pylist() for c in ("lo", "hi", "ids", "spans"))):
                    starts = {l: s["start"] for x, y in zip(lo, spans) for l, s in zip(x, y)}
                    ends = {h: s["end"] for x, y in zip(hi, spans) for h, s in zip(x, y)}
                    whole = runs([p for x, y in zip(lo, hi) for p in zip(x, y)])
                    row |= {"n_hit": sum(h - l for l, h in whole), "ids": sorted({i for z in ids for i in z}), "spans": [{"start": starts[l], "end": ends[h]} for l, h in whole]}
                cols = [pa.array([r["n_hit"] for r in rows], pa.int64()), pa.array([r["ids"] for r in rows], pa.list_(pa.string())), pa.array([r["spans"] for r in rows], _SPANS)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), *cols], ["doc_id", "n_words", "n_hit", "ids", "spans"])

        group = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.collect_list(c).alias(c) for c in ("lo", "hi", "ids", "spans")])  # a row for each block
        out = group.drop("key").mapInArrow(merge, "doc_id long, n_words long, n_hit long, ids array<string>, spans array<struct<start:long,end:long>>")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = W) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    blocks = _blocks(benchmark)

    if len(blocks) > 1:  # spans of all blocks count together
        scratch, row = Scratch(spark, "decontam"), fresh(docs, "row")
        numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = contamination(spark, numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, width)
        bad = scratch.keep(found.filter("contaminated").select(F.col("doc_id").alias(row)), "bad")
        return numbered.join(bad, row, "left_anti").select(*docs.columns)
    shared = _items(benchmark, blocks[0])
    small_batches(spark)
    items, name = spark.sparkContext.broadcast(shared), hashlib.sha256(repr((width, shared)).encode()).hexdigest()
    at = docs.columns.index("text")

    def keep(batches):
        if name not in _matchers:
            _matchers.clear()
            _matchers[name] = Matcher(items.value, width)
        m = _matchers[name]
        for b in batches:
            ok = []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                w = words_of(t or b"")
                n = covered(m.scan(w)[0])
                ok.append(not (n > 0 and 20 * n >= len(w)))
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
