"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is lower-cased and cut into tokens, the same way whatever else it holds: single characters of scripts without spaces,
and runs of other letters, marks and digits, in pieces of at most PIECE from the run's start; all else separates.  A k-mer is
K tokens in a row, an s-mer S of them; the k-mer is a closed syncmer, and an anchor, if the least of its s-mer hashes is that
of its first or last s-mer.  Whether it is one depends on its own tokens alone, so anchors of a shared passage agree wherever
it stands.  The fingerprint lists the distinct anchors' 32-bit hashes in text order; likeness matches two lists by anchor and
by place in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens in a k-mer and in an s-mer: each k-mer holds the s-mers at 0, 1, 2 and 3.
K, S = 5, 2
PIECE = 16
_LONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{_LONE}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{_LONE}]]{{1,{PIECE}}}"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array<int> column ``out`` of the anchors of column ``text``.

    Null and empty texts have none; a text without tokens (only spaces, signs) has one, of all its characters; a text of fewer than K tokens,
    or (of K or K+1 tokens) without a closed syncmer, has one, of all its tokens.
    """
    t, s = f"_t_{out}", f"_s_{out}"
    df = df.withColumn(t, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    n = F.size(t)
    df = df.withColumn(s, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1)))))
    at = lambda i, j: F.get(s, i + j)
    ends = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(at(i, 0), at(i, 3)) <= F.least(at(i, 1), at(i, 2)))
    many = F.array_distinct(F.transform(ends, lambda i: F.hash(at(i, 0), at(i, 2), at(i, 3))))
    few = F.array(F.hash(F.col(t)))
    none = F.when(F.length(text) > 0, F.array(F.hash(F.col(text)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(out, F.when(n >= K, many))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).when(n > 0, few).otherwise(none)).drop(t, s)


def likeness(a: str, b: str) -> Column:
    """Common anchors that follow each other in both lists, as a share of all anchors of the two.

    Of n common anchors in the order of ``a``, each that does not come right after the one before it in the order of ``b``
    too is a break; likeness is (n - breaks) / union, so the Jaccard index where the order agrees.  Two empty lists are alike
    (1), one empty list is unlike any other (0).
    """
    pairs = lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda p, q: F.when(q.isNotNull(), F.shiftleft(p.cast("long"), 32).bitwiseOR(q.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    here, there = F.array_intersect(a, b), F.array_intersect(b, a)
    n = F.size(here)
    follow = F.size(F.array_compact(F.array_intersect(pairs(here), pairs(there))))
    union = F.size(a) + F.size(b) - n
    return F.when(union == 0, F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise((follow + 1) / union)


def as_text(a: str) -> Column:
    return F.array_join(F.col(a).cast("array<string>"), " ")


def _bucket(bounds: list[int]) -> Column:
    """Number of the bounds that are <= doc_id, by binary search; null ids get -1 (they are last in descending order)."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    step, steps = 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    arr = F.array(*[F.lit(x).cast("long") for x in bounds]) if len(bounds) < 64 else F.expr("array(" + ",".join(f"{x}L" for x in bounds) + ")")
    at = F.lit(0)
    found = F.aggregate(
        F.array(*[F.lit(x) for x in steps]), at,
        lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(arr, acc + s - 1) <= F.col("doc_id")), acc + s).otherwise(acc),
    )
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for the columns: the values of the next row in descending doc_id; after the last: the first.

    Rows of equal doc_id follow each other by text.  One shuffle of the rows into ranges of ids; the first row of a range
    is also sent, as a ghost, to the end of the range before it.  Ranges come from approximate quantiles of the ids (a few
    for every shuffle partition), so none grows with the table's skew in ids.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    ids = docs.select("doc_id")
    got = ids.agg(F.percentile_approx("doc_id", F.expr("array(" + ",".join(f"{c!r}D" for c in cuts) + ")"), F.lit(max(10_000, 10 * parts))).alias("b")).first()["b"]
    bounds = sorted(set(got or []))
    tops = ids.withColumn("b", _bucket(bounds)).groupBy("b").agg(F.max("doc_id").alias("top")).collect()  # at most parts + 1 rows
    tops = sorted(((r["b"], r["top"]) for r in tops), reverse=True)
    if not tops:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    before = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}  # the first range's ghost goes to the end of the last
    here = F.col("_b")
    ghost_of = F.expr("map(" + ",".join(f"{b},{p}" for b, p in before.items()) + ")")
    top_of = F.expr("map(" + ",".join(f"{b},{'NULL' if t is None else t}{'' if t is None else 'L'}" for b, t in tops) + ")")
    df = docs.withColumn("_b", _bucket(bounds))
    is_top = F.col("doc_id").eqNullSafe(F.element_at(top_of, here).cast("long"))
    places = F.when(is_top, F.array(F.struct(here.alias("b"), F.lit(False).alias("g")), F.struct(F.element_at(ghost_of, here).alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(here.alias("b"), F.lit(False).alias("g"))))
    df = df.withColumn("_p", F.explode(places)).drop("_b")
    w = Window.partitionBy("_p.b").orderBy(F.col("_p.g"), F.desc_nulls_last("doc_id"), F.col("text"))
    df = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return df.filter(~F.col("_p.g")).drop("_p")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half replaced by the start of the next document).

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  Null texts count as
    empty; two empty fingerprints are alike; null doc_ids come after all others; repeated rows each keep their row;
    a lone row is its own next; other columns are ignored; an empty table gives no row.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_anchors(base, "text", "a"), ["text", "a"])
    n = F.char_length("text")
    df = df.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 2)))"), F.expr("left(next_text, int(floor(char_length(text) / 2)))")))
    df = with_anchors(df.select("doc_id", n.cast("long").alias("n_chars"), "edited", "a", "next_a"), "edited", "e")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("a").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"), likeness("a", "next_a").alias("near_next"),
    )
