"""Whole sets are dealt once: joins on their class do not deal them again."""

from pyspark.sql import functions as F

from geoshroud.llm import ngram_join
from geoshroud.llm.scratch import Scratch


def test_joins_read_the_sets_where_they_lie(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)] + [(3, " ".join(f"w3x{j}" for j in range(30)))], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    rows = ngram_join._described(docs, 4, 85, ngram_join._frequent(docs, 4)).dropDuplicates(["doc_id"])
    classes = scratch.keep(rows.select(F.col("doc_id").alias("v"), "doc_id", "hi"), "classes")
    sets = ngram_join._Sets(docs, classes, 4, scratch)
    for few in (10, 40):  # the second call adds to the first one's table
        pairs = scratch.keep(spark.range(few - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "pairs")
        whole = sets.of(pairs)
        assert sorted(r.v for r in whole.collect()) == list(range(few))
        plan = pairs.join(whole.select(F.col("v").alias("a"), "s").hint("merge"), "a")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    table = sets.table
    sets.close()
    assert not spark.catalog.tableExists(table)
