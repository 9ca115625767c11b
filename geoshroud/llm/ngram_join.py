"""N-gram Jaccard join by a grouped prefix join; whole connected components, no pairs inside them.

Steps (all tables below are Parquet in the shared folder, so lost executors cost a reread):

1. every text becomes its set of k-word shingles (64-bit hashes); equal sets collapse into one class;
2. sets are ordered with locally frequent shingles last, then by hash; the first |x|-ceil(t|x|)+1 are the prefix:
   two sets that link share a prefix shingle.  The order is a heuristic, any order gives the same links;
3. shingles with one posting list count as one.  Classes of equal prefix and size form a group.  Group representatives meet on shared prefix shingles under the
   size and position bounds, members meet their representative; met pairs are verified on the whole sets;
   Tables that grow with the corpus are merge-joined at every size, so plans on small inputs say what large ones cost;
4. groups are expanded: shingles whose members lie in several components are taken up again.  A few star rounds
   (one pivot for a shingle) merge most of them; a last round verifies every pair left between different components
   with at least one side outside the shingle's largest component.  Pairs inside one component prove nothing new and
   are never made, so a group of n near copies costs O(n), not O(n^2);
5. only where links are asked for, all pairs inside each component are compared, in blocks, and counted.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import merge_labels
from .hashing import shingle_set
from .scratch import Scratch, fresh, small_batches

#: At most so many frequent shingles are sent to the executors (8 bytes each); the others keep their hash order.
MAX_FREQUENT = 1_000_000
#: Ids of at most so many candidates are broadcast for the second scan; beyond that the scan is joined by shuffle.
MAX_BROADCAST_IDS = 500_000
#: A task counts so many shingles at once (8 bytes each).
COUNTED = 6_000_000
#: A frequent shingle is in so many different texts, counted where a task sees it so many times.
FREQUENT, LOCALLY = 8, 3
#: Prefix shingles meet in so many passes, by hash; the shuffle files of one pass are deleted before the next.
SLICES = 2
STAR_ROUNDS = 4
#: Lists with more rows than this outside their largest component are compared by differences from a pivot, in at most so many
#: rounds; a class is near its pivot if it differs in at most this share of its shingles.
CROWDED, PIVOT_ROUNDS, CORE = 8, 2, 0.25
#: Bits of the parity marks by which most pairs that cannot link are refused inside the join.
MARK_BITS = 512
#: The last round starts as soon as it makes at most so many pairs for each row of the open shingles, or as soon as a
#: star round did not halve the pairs left (then more of them would only cost time).
LINEAR = 4
#: Links inside a component are counted for two blocks at a time, of about so many classes and at most about so many
#: shingles each, and for so many different shingles at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1_000_000, 4096


def _texts(batches, *columns):
    for b in batches:
        t = b.column("text").cast(pa.binary()).to_pylist()
        yield b, t, *[b.column(c) for c in columns]


def _counted(tok: np.ndarray) -> list[pa.Array]:
    """Values that ``tok`` has LOCALLY times or more, and how many times; ``tok`` is sorted in place."""
    tok.sort()
    often = np.unique(tok[LOCALLY - 1 :][tok[LOCALLY - 1 :] == tok[: len(tok) - LOCALLY + 1]])
    return [pa.array(often), pa.array(np.searchsorted(tok, often, "right") - np.searchsorted(tok, often))]


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of at least FREQUENT different texts, as far as tasks see them LOCALLY times: they are ordered last.

    The bounds do not grow with the corpus, or posting lists would, and pairs with their square.
    """

    def count(batches):
        buf, n, known = np.empty(COUNTED, np.int64), 0, set()  # filled and sorted in place: a task holds it once
        for _, texts in _texts(batches):
            for t in texts:
                copy = hash(t)
                if t is None or copy in known:
                    continue
                s = shingle_set(t, k)
                if n + len(s) > COUNTED:
                    yield pa.RecordBatch.from_arrays(_counted(buf[:n]), ["tok", "c"])
                    n, known = 0, set()
                known.add(copy)
                if len(s) <= COUNTED:  # alone, a longer set has each shingle once
                    buf[n : n + len(s)] = s
                    n += len(s)
        if n:
            yield pa.RecordBatch.from_arrays(_counted(buf[:n]), ["tok", "c"])

    rows = (
        docs.select("text").mapInArrow(count, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c"))
        .filter(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "tok").limit(MAX_FREQUENT).select("tok").toPandas()
    )
    return np.sort(rows["tok"].to_numpy(np.int64))


def _described(docs: DataFrame, k: int, pct: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, hash of the text, n_shingles, key of the set, and the prefix in order."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent)

    def describe(batches):
        freq = hot.value
        for b, texts, ids, t64 in _texts(batches, "doc_id", "t"):
            n, hi, lo, prefix, marks = [], [], [], [], []
            for t in texts:
                s = shingle_set(t, k)
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), prefix.append(None), marks.append(None)
                    continue
                odd = np.bincount(s & (MARK_BITS - 1), minlength=MARK_BITS) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                hi.append(int(key[0])), lo.append(int(key[1]))
                p = len(s) + (-pct * len(s)) // 100 + 1
                if len(freq):
                    at = np.searchsorted(freq, s)
                    at[at == len(freq)] = 0
                    last = freq[at] == s
                    s = np.concatenate([s[~last], s[last]])
                prefix.append(s[:p])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), t64, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "t", "n", "hi", "lo", "prefix", "marks"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(describe, "doc_id long, t long, n long, hi long, lo long, prefix array<long>, marks array<long>")


class _Sets:
    """Whole sets of the classes that some candidate pair names, from further scans of the texts; each is built once, and
    dealt once, by class."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, scratch: Scratch):
        if not docs.filter("doc_id is null").isEmpty():  # rows without an id are found by the key of their set
            docs, classes = (t.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**62)))) for t in (docs, classes))
        self.docs, self.ids, self.k, self.scratch, self.known = docs, classes.select("v", "doc_id", "hi"), k, scratch, None
        self.table = f"sets_{uuid.uuid4().hex}"
        self.repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()

    def of(self, pairs: DataFrame) -> DataFrame:
        """v and s of at least every class in ``pairs`` (a, b)."""
        v = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
        if self.known is not None:
            v = v.join(self.known.select("v"), "v", "left_anti")
        wanted = self.scratch.keep(v.join(self.ids, "v"), "wanted")
        self.scratch.reclaim()  # sets are the largest rows: what led to the pairs goes first
        n = wanted.count()
        few = n <= MAX_BROADCAST_IDS
        k, here = self.k, self.docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")

        def build(batches):
            for b, texts, v, hi in _texts(batches, "v", "hi"):
                sets = [shingle_set(t, k) for t in texts]
                keys = [None if not len(s) else int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)[0]) for s in sets]
                own = pa.array([x == y for x, y in zip(keys, hi.to_pylist())])
                yield pa.RecordBatch.from_arrays([v, pa.array(sets, pa.list_(pa.int64())), pa.array([_wide_mark(s) for s in sets], pa.binary()), own], ["v", "s", "w", "own"])

        # rows that share a doc_id but not the set are other classes' rows
        new = here.select("v", "hi", "text").mapInArrow(build, "v long, s array<long>, w binary, own boolean").filter("own").drop("own")
        if self.known is None or n:
            if self.repeated:  # repeated rows each give their set
                new = new.dropDuplicates(["v"])
            self.known = self.scratch.append_keyed(new, self.table, "v")
            self.scratch.reclaim()
        return self.known

    def close(self) -> None:
        self.scratch.drop_keyed(self.table)


def _wide_mark(s: np.ndarray) -> bytes:
    """Parity mark with four to eight bits for each shingle, so that it stays telling for long texts."""
    bits = max(MARK_BITS, 4 << int(len(s)).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(wa: bytes, wb: bytes) -> int:
    """In how many shingles two sets differ at least; the longer mark is folded on the shorter."""
    wa, wb = np.frombuffer(wa, np.uint8), np.frombuffer(wb, np.uint8)
    short = min(len(wa), len(wb))
    wa, wb = (np.bitwise_xor.reduce(w.reshape(-1, short)) for w in (wa, wb))
    return int(np.bitwise_count(wa ^ wb).sum())


def _wide_marks_allow(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs that wide marks do not refuse."""
    a = sets.select(F.col("v").alias("a"), F.size("s").alias("na"), F.col("w").alias("wa"))
    b = sets.select(F.col("v").alias("b"), F.size("s").alias("nb"), F.col("w").alias("wb"))

    def keep(batches):
        for x in batches:
            ok = []
            for na, nb, wa, wb in zip(*(x.column(c).to_pylist() for c in ("na", "nb", "wa", "wb"))):
                ok.append((100 + pct) * (na + nb - _apart(wa, wb)) >= 2 * pct * (na + nb))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """The pairs that link, by their whole sets."""
    pairs = scratch.keep(_wide_marks_allow(pairs, sets, pct), "likely")
    # the class with more pairs comes first, as rows that carry a set are then dealt by the other one
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("k"))
    ends = scratch.keep(ends.filter("k > 1"), "ends")
    often = [F.coalesce(k, F.lit(1)) for k in ("ka", "kb")]
    pairs = pairs.join(ends.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a", "left").join(ends.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b", "left")
    pairs = scratch.keep(pairs.select(F.when(often[0] >= often[1], F.col("a")).otherwise(F.col("b")).alias("a"), F.when(often[0] >= often[1], F.col("b")).otherwise(F.col("a")).alias("b")), "turned")
    scratch.reclaim()
    a = sets.select(F.col("v").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("same"))
    return both.filter(F.lit(100) * F.col("same") >= F.lit(pct) * (F.col("both") - F.col("same"))).select("a", "b")


def _unrefused(pairs: DataFrame, marks: DataFrame, pct: int) -> DataFrame:
    """The pairs that sizes and parity marks do not refuse: only they cost whole sets."""
    a = marks.select(F.col("v").alias("a"), "n", "marks")
    b = marks.select(F.col("v").alias("b"), F.col("n").alias("n2"), F.col("marks").alias("marks2"))
    return pairs.join(a, "a").join(b, "b").filter(_marks_allow(pct)).select("a", "b")


def _may_link(pct: int):
    """Size bound, and the bound on what is common after a first common shingle at positions p and q."""
    need = F.lit(pct) * (F.col("n") + F.col("n2"))
    return (
        (F.lit(100) * F.least("n", "n2") >= F.lit(pct) * F.greatest("n", "n2"))
        & (F.lit(100 + pct) * (F.lit(1) + F.least(F.col("n") - F.col("p") - 1, F.col("n2") - F.col("p2") - 1)) >= need)
    )


def _marks_allow(pct: int):
    """The parity marks of two sets differ in at most as many bits as the sets differ in shingles."""
    apart = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("marks2")[i])) for i in range(MARK_BITS // 64))
    return F.lit(100 + pct) * (F.col("n") + F.col("n2") - apart) >= F.lit(2 * pct) * (F.col("n") + F.col("n2"))


def _collapsed(parts: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``parts`` with one row for all shingles that the same classes have, at the least position in each class.

    A passage gives many shingles with one posting list; they would make the same pairs again and again.  Lists are told
    apart by size and xor of their class keys: should two differ and agree in that, they only make pairs to be refused.
    """
    met = functools.reduce(DataFrame.union, parts)
    lists = met.groupBy("tok").agg(F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("v"))).alias("list"))
    out = met.join(lists.hint("merge"), "tok").groupBy("list", "v").agg(F.first("n").alias("n"), F.min("p").alias("p"))
    out = scratch.keep(out.select("v", "n", "p", F.col("list").alias("tok")), "met")
    scratch.drop(*parts)
    return out


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).filter("a <> b").distinct()


def _without(kept: DataFrame, column: str) -> DataFrame:
    out = kept.drop(column)
    out._scratch_path = kept._scratch_path
    return out


def _open(met: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ``met``, with their component c, of the shingles that lie in several; each shingle's largest component ``main``,
    its rows ``most`` and all rows ``k``.  Nothing where no shingle is open."""
    here = met.join(labels.hint("merge"), "v")
    open_ = here.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("tok")
    here = scratch.keep(here.join(open_.hint("merge"), "tok"), "open")
    if here.isEmpty():
        return None, None
    size = here.groupBy("tok", "c").agg(F.count("*").alias("k"))
    return here, scratch.keep(size.groupBy("tok").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("k")), "main")


def _met(here: DataFrame, rest: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """Pairs of a class of ``here`` and one of ``rest`` on one shingle, in different components, that no bound refuses."""
    rest = rest.select("tok", F.col("v").alias("v2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("marks").alias("marks2"))
    return scratch.keep(_pairs(here.join(rest.hint("merge"), "tok").filter(F.col("c") != F.col("c2")).filter(_may_link(pct)).filter(_marks_allow(pct))), "pairs")


def _by_differences(crowded: DataFrame, labels: DataFrame, marks: DataFrame, sets: _Sets, pct: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels after all links that a class near a pivot has within ``crowded`` (tok, v, c, main); and those (main, v).

    Every component ``main`` has one pivot set P, and a class x is held by its difference S = x xor P.  With m = |S|, n = |x|
    and F = (100 + pct) m - (100 - pct) n, x and y link exactly when F(x) + F(y) <= 2 (100 + pct) |S(x) and S(y)|:

    * where F(x) + F(y) <= 0 they link whatever they share, and then both link with the class of least F: a star says it all;
    * else their differences share at least one shingle, and after their first one (rare shingles come first) enough are left.
      Classes of a shingle with F in one step form a group; group pairs that their bounds refuse go, the others are expanded.

    A class is near if m <= CORE n; whatever links with it has a difference of at most the bound used below (by the triangle
    inequality), so a near class is done with after this.
    """
    up, down = 100 + pct, 100 - pct
    far = (CORE + down / up) * 100 / pct + down / up
    core = lambda n: CORE * n
    reach = lambda n: far * n + 1
    often = crowded.filter("c = main").groupBy("main", "v").agg(F.count("*").alias("k"))
    pivots = scratch.keep(often.groupBy("main").agg(F.max_by("v", F.struct("k", -F.col("v"))).alias("pivot")), "pivots")
    near = crowded.select("main", "v").distinct().join(pivots.hint("merge"), "main")
    p = marks.select(F.col("v").alias("pivot"), F.col("n").alias("n2"), F.col("marks").alias("marks2"))
    apart = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("marks2")[i])) for i in range(MARK_BITS // 64))
    near = near.join(marks.hint("merge"), "v").join(p.hint("merge"), "pivot").filter(F.greatest(apart, F.abs(F.col("n") - F.col("n2"))) <= reach(F.col("n"))).select("main", "pivot", "v")
    near = scratch.keep(near, "near")
    whole = sets.of(near.select(F.col("pivot").alias("a"), F.col("v").alias("b")))
    first = near.select("pivot").distinct().join(whole.select(F.col("v").alias("pivot"), F.col("s").alias("sp"), F.col("w").alias("w2")).hint("merge"), "pivot")
    first = scratch.keep(first, "pivot-sets")  # far fewer than all sets
    likely = near.join(whole.select("v", "w", F.size("s").alias("n")).hint("merge"), "v").join(first.select("pivot", "w2").hint("merge"), "pivot")

    def in_reach(batches):  # whole sets travel only for classes that wide marks do not refuse
        for x in batches:
            ok = [_apart(*ww) <= reach(n) for n, *ww in zip(*(x.column(c).to_pylist() for c in ("n", "w", "w2")))]
            yield x.select(["main", "pivot", "v"]).filter(pa.array(ok, pa.bool_()))

    near = scratch.keep(likely.select("main", "pivot", "v", "n", "w", "w2").mapInArrow(in_reach, "main long, pivot long, v long"), "in-reach")
    both = near.join(whole.select("v", "s").hint("merge"), "v").join(first.select("pivot", "sp").hint("merge"), "pivot")

    def differ(batches):
        for x in batches:
            n, out = [], []
            for s, sp in zip(x.column("s"), x.column("sp")):
                s = s.values.to_numpy()
                n.append(len(s))
                out.append(np.setxor1d(s, sp.values.to_numpy(), assume_unique=True))
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("main", "pivot", "v")), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["main", "pivot", "v", "n", "s"])

    found = both.select("main", "pivot", "v", "s", "sp").mapInArrow(differ, "main long, pivot long, v long, n long, s array<long>")
    found = found.withColumn("m", F.size("s").cast("long")).withColumn("f", F.col("m") * up - F.col("n") * down).filter(F.col("m") <= reach(F.col("n")))
    found = scratch.keep(found, "differences")
    scratch.drop(first)
    least = found.groupBy("pivot").agg(F.min_by(F.struct("f", "v"), F.struct("f", "v")).alias("l")).select("pivot", F.col("l.f").alias("f2"), F.col("l.v").alias("b"))
    star = found.select("pivot", "v", "f").join(least.hint("merge"), "pivot").filter("f + f2 <= 0 and v <> b").select(F.col("v").alias("a"), "b")
    labels = merge_labels(labels, scratch.keep(star, "star"), scratch)

    held = found.select("pivot", "v", "m", "f", (F.col("m") <= core(F.col("n"))).alias("core"), F.explode("s").alias("u"))
    common = held.groupBy("pivot", "u").agg(F.count("*").alias("df")).filter("df > 1")
    back = Window.partitionBy("pivot", "v").orderBy(F.desc("df"), F.desc("u"))
    held = held.join(common.hint("merge"), ["pivot", "u"]).withColumn("rem", F.row_number().over(back).cast("long")).withColumn("step", F.floor(F.col("f") / (2 * up)))
    held = scratch.keep(held.drop("df", "m"), "held")
    scratch.reclaim()
    enough = F.least("rem", "rem2") * (2 * up) >= F.col("f") + F.col("f2")
    for turn in ("hub", "rest"):  # first each shingle's class of least F, which merges most; then whatever is left
        here = held.join(labels.hint("merge"), "v")
        sizes = here.groupBy("pivot", "u", "c").agg(F.count("*").alias("k"))
        sizes = sizes.groupBy("pivot", "u").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("pivot", "u", "most")
        here = scratch.keep(here.join(sizes.hint("merge"), ["pivot", "u"]), f"open-{turn}")
        if turn == "hub":
            hubs = here.groupBy("pivot", "u").agg(F.min_by(F.struct("f", "v", "c", "rem", "core"), F.struct("f", "v")).alias("h"))
            met = here.join(hubs.select("pivot", "u", *[F.col(f"h.{c}").alias(f"{c}2") for c in ("f", "v", "c", "rem", "core")]).hint("merge"), ["pivot", "u"])
        else:
            groups = here.groupBy("pivot", "u", F.col("step").alias("step2")).agg(F.min("f").alias("f2"), F.max("rem").alias("rem2"), F.min("c").alias("lo"), F.max("c").alias("hi"))
            asks = here.filter("c <> most").join(groups.hint("merge"), ["pivot", "u"]).filter(enough).filter("lo <> hi or lo <> c")
            asks = scratch.keep(asks.select("pivot", "u", F.col("step2").alias("step"), *[F.col(c).alias(f"{c}2") for c in ("f", "v", "c", "rem", "core")]), "asks")
            met = here.select("pivot", "u", "step", "f", "v", "c", "rem", "core").join(asks.hint("merge"), ["pivot", "u", "step"])
        pairs = met.filter("c <> c2 and (core or core2)").filter(enough)
        pairs = scratch.keep(pairs.select("pivot", F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct(), "pairs")
        a, b = (found.select("pivot", F.col("v").alias(x), F.col("f").alias(f"f{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
        links = pairs.join(a.hint("merge"), ["pivot", "a"]).join(b.hint("merge"), ["pivot", "b"]).filter(F.size(F.array_intersect("sa", "sb")) * (2 * up) >= F.col("fa") + F.col("fb"))
        labels = merge_labels(labels, scratch.keep(links.select("a", "b"), "links"), scratch)
    done = scratch.keep(found.filter(F.col("m") <= core(F.col("n"))).select("main", "v"), "done")
    scratch.drop(near, held, found)
    return labels, done


def _joined(spark: SparkSession, docs: DataFrame, k: int, pct: int):
    """Scratch space, rows, classes, labels of the classes with a shared shingle, and whole sets."""
    small_batches(spark)
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(_described(docs, k, pct, _frequent(docs, k)), "rows")
    classes = (
        rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
        .withColumn("v", F.monotonically_increasing_id())  # fixed by the table that keep() writes
    )
    classes = scratch.keep(classes, "classes")
    slim = scratch.keep(rows.select("doc_id", "t", "n", "hi", "lo"), "slim-rows")
    scratch.drop(rows)
    rows = slim
    tokens = classes.select("v", "n", F.posexplode("prefix").alias("p", "tok"))
    parts = []
    for i in range(SLICES):
        some = tokens.filter(F.pmod("tok", F.lit(SLICES)) == i)
        shared = some.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok")
        shared = scratch.keep(shared, "shared")
        scratch.reclaim()
        parts.append(scratch.keep(some.join(shared.hint("merge"), "tok"), "met-shingles"))
        scratch.drop(shared)
    slim = scratch.keep(classes.withColumn("g", F.xxhash64("prefix", "n")).drop("prefix"), "slim-classes")
    scratch.drop(classes)  # prefixes are in met from here on
    classes = slim
    met = _collapsed(parts, scratch)
    reps = classes.groupBy("g").agg(F.min("v").alias("rep"), F.count("*").alias("members")).filter("members > 1").select("g", "rep")
    members = scratch.keep(classes.select("g", "v").join(reps, "g").filter("v <> rep").select("v", "rep"), "members")
    labels = scratch.keep(met.select("v").distinct().withColumn("c", F.col("v")), "labels")
    marks = scratch.keep(classes.join(labels.select("v").hint("merge"), "v").select("v", "n", "marks"), "marks")
    sets = _Sets(docs, classes, k, scratch)
    scratch.reclaim()

    # groups: members meet their representative, representatives meet the pivot of each shingle
    inner = members.select("v", F.col("rep").alias("v2"))
    reps = met.join(members.select("v"), "v", "left_anti")
    pivots = reps.groupBy("tok").agg(F.min(F.struct("v", "n", "p")).alias("m")).select("tok", F.col("m.v").alias("v2"), F.col("m.n").alias("n2"), F.col("m.p").alias("p2"))
    outer = reps.join(pivots.hint("merge"), "tok").filter(F.col("v") != F.col("v2")).filter(_may_link(pct)).select("v", "v2")
    pairs = scratch.keep(_unrefused(_pairs(inner.union(outer)), marks, pct), "pairs")
    links = scratch.keep(_verified(pairs, sets.of(pairs), pct, scratch), "links")
    scratch.reclaim()
    labels = merge_labels(labels, links, scratch)
    seen, before, opened = met, float("inf"), None
    for turn in range(STAR_ROUNDS):  # a shingle within one component stays so: each round takes up what the last left open
        here, main = _open(seen, labels, scratch)
        scratch.drop(seen)
        if here is None:
            return scratch, rows, classes, labels, sets
        seen = _without(here, "c")
        work = main.agg(F.sum((F.col("k") - F.col("most")) * F.col("k").cast("double")).alias("pairs"), F.sum("k").alias("rows")).first()
        if work["pairs"] <= LINEAR * work["rows"] or 2 * work["pairs"] > before:
            opened = here, main
            break
        before = work["pairs"]
        here = here.join(marks.select("v", "marks").hint("merge"), "v")
        rest = here.join(main.select("tok", "main").hint("merge"), "tok").filter(F.col("c") != F.col("main"))
        rest = rest.groupBy("tok").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("x"), "v", "c", "n", "p", "marks")).alias("m")).select("tok", "m.*")
        pairs = _met(here, rest, pct, scratch)
        scratch.reclaim()
        labels = merge_labels(labels, scratch.keep(_verified(pairs, sets.of(pairs), pct, scratch), f"links{turn}"), scratch)
        scratch.drop(main)
    for turn in range(PIVOT_ROUNDS):
        if opened is None:
            opened = _open(seen, labels, scratch)
            scratch.drop(seen)
        else:
            scratch.reclaim()
        here, main = opened
        if here is None:
            return scratch, rows, classes, labels, sets
        seen = _without(here, "c")
        crowded = main.filter(F.col("k") - F.col("most") > CROWDED).select("tok", "main")
        if crowded.isEmpty():
            break
        opened = None
        crowded = scratch.keep(here.join(crowded.hint("merge"), "tok"), f"crowded{turn}")
        labels, done = _by_differences(crowded, labels, marks, sets, pct, scratch)
        left = crowded.join(done.hint("merge"), ["main", "v"], "left_anti").select(*seen.columns)
        calm = seen.join(crowded.select("tok").distinct().hint("merge"), "tok", "left_anti").select(*seen.columns)
        fewer = scratch.keep(calm.union(left), "met")
        scratch.drop(seen, crowded)
        seen = fewer
    here, main = opened or _open(seen, labels, scratch)
    if here is not None:
        here = here.join(marks.select("v", "marks").hint("merge"), "v")
        rest = here.join(main.select("tok", "main").hint("merge"), "tok").filter(F.col("c") != F.col("main"))
        pairs = _met(here, rest, pct, scratch)
        scratch.reclaim()
        labels = merge_labels(labels, scratch.keep(_verified(pairs, sets.of(pairs), pct, scratch), "links"), scratch)
    return scratch, rows, classes, labels, sets


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = classes.select("hi", "lo", "v", "doc_id").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id`` for every row of ``docs`` (columns ``doc_id``, ``text``).

    Two rows link when 100 * |A and B| >= pct * |A or B| on their sets of k-word shingles.  component_id is the smallest
    doc_id reachable.  Null, empty and blank texts have no shingles and link with nothing: component_id is their own doc_id.
    Repeated rows are in one class; a null doc_id stays null and takes the smallest non-null doc_id of its component.
    Columns other than doc_id and text are ignored.  Very long texts are hashed in pieces.  An empty table gives no row.
    """
    return _components(spark, docs, k, pct).drop("t")


def _components(spark: SparkSession, docs: DataFrame, k: int, pct: int) -> DataFrame:
    """``jaccard_components`` with the hash ``t`` of every row's text."""
    scratch, rows, classes, labels, sets = _joined(spark, docs, k, pct)
    named = scratch.keep(_named(classes, labels).select("hi", "lo", "component_id"), "named")
    sets.close()
    out = rows.select("doc_id", "t", F.col("n").alias("n_shingles"), "hi", "lo").join(named, ["hi", "lo"], "left")
    return out.select("doc_id", "t", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _same(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``sets[a]`` with ``sets[b]``; shingles are taken COLUMNS at a time."""
    tok, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = n > 1  # in one set only: in no intersection
    which, col = which[twice[col]], (np.cumsum(twice) - 1)[col[twice[col]]]
    order = np.argsort(col, kind="stable")
    which, col = which[order], col[order]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, int(twice.sum()), COLUMNS):
        i, j = np.searchsorted(col, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[which[i:j], col[i:j] - lo] = 1
        out += x[a] @ x[b].T
    return out


def _links_of(classes: DataFrame, labels: DataFrame, rows: DataFrame, sets: _Sets, pct: int, scratch: Scratch) -> DataFrame:
    """v and n_links of every class: the other rows that a row of it links with.

    Classes that link are in one component, so all pairs of each component are compared on their whole sets.  A component
    is dealt at random into blocks of about BLOCK classes or BLOCK_SHINGLES shingles; a task compares two blocks and
    returns counts, never pairs.
    """
    copies = rows.filter("n > 0").groupBy("hi", "lo").agg(F.count("*").alias("copies"))
    known = scratch.keep(classes.select("v", "n", "hi", "lo").join(copies.hint("merge"), ["hi", "lo"]).select("v", "n", "copies"), "copies")
    inside = known.join(labels.hint("merge"), "v")
    size = inside.groupBy("c").agg(F.count("*").alias("m"), F.sum("n").alias("all")).filter("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    inside = scratch.keep(inside.join(size.select("c", blocks.alias("blocks")).hint("merge"), "c").withColumn("i", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")), "inside")
    whole = sets.of(inside.select(F.col("v").alias("a"), F.col("v").alias("b"))).select("v", "s")
    dealt = inside.join(whole.hint("merge"), "v").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "v", "copies", "s")

    def count(t: pa.Table) -> pa.Table:
        s = [np.asarray(x, np.int64) for x in t.column("s").to_pylist()]
        i, copies, n = (np.array(x, np.int64) for x in (t.column("i").to_pylist(), t.column("copies").to_pylist(), [len(x) for x in s]))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        a, b = np.flatnonzero(i == x), np.flatnonzero(i == y)
        same = _same(s, a, b)
        link = 100 * same >= pct * (n[a][:, None] + n[b][None, :] - same)
        out = np.zeros(len(s), np.int64)
        if x == y:
            np.fill_diagonal(link, False)
            out[a] = link @ copies[b]
        else:
            out[a], out[b] = link @ copies[b], copies[a] @ link
        return pa.table({"v": t.column("v").cast(pa.int64()), "n_links": pa.array(out)})

    found = dealt.groupBy("c", "x", "y").applyInArrow(count, "v long, n_links long").groupBy("v").agg(F.sum("n_links").alias("n_links"))
    found = scratch.keep(found, "n-links")
    return known.join(found.hint("merge"), "v", "left").select("v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def jaccard_links(spark: SparkSession, docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """Rows of ``jaccard_components`` with ``n_links``: with how many other rows each links, exact copies included.

    All links are counted, those inside a component too, which costs the square of the component.  Null, empty and blank
    texts have 0.
    """
    scratch, rows, classes, labels, sets = _joined(spark, docs, k, pct)
    links = _links_of(classes, labels, rows, sets, pct, scratch)
    named = scratch.keep(_named(classes, labels).join(links.hint("merge"), "v").select("hi", "lo", "component_id", "n_links"), "named")
    sets.close()
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(named, ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id; all columns as they are.

    Texts without shingles and rows without a doc_id all stay.  Of rows that repeat both doc_id and text one stays; where
    different texts share a doc_id, each stays or goes with its own component.
    """
    scratch = Scratch(spark, "keep-one")
    t = fresh(docs, "t")
    found = scratch.keep(_components(spark, docs, k, pct).withColumnRenamed("t", t), "components")
    gone = scratch.keep(found.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id", t).distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    kept = docs.withColumn(t, F.xxhash64("text")).join(F.broadcast(gone) if few else gone, ["doc_id", t], "left_anti")
    twice = scratch.keep(found.groupBy("doc_id", t).agg(F.count("*").alias("c")).filter("c > 1 and doc_id is not null").select("doc_id", t), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, ["doc_id", t], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, ["doc_id", t], "left_anti").unionByName(once).select(*docs.columns)
