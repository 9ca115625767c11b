"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoshroud.llm.decontam import without_contaminated
from geoshroud.llm.ngram_join import keep_one
from geoshroud.llm.packing import pack
from geoshroud.llm.scratch import Scratch
from geoshroud.llm.suffix_dedup import without_repeats
from geoshroud.llm.toxicity import without_toxic

#: Bytes of a repeated string that the suffix stage cuts: under 50 words of the shortest common kind.
REPEAT_BYTES = 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard index 0.8)."""
    return keep_one(spark, docs, k=5, pct=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their strings of REPEAT_BYTES bytes that start anywhere else too."""
    return without_repeats(spark, docs, n=REPEAT_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(spark, docs)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]
#: The model fit of the first stage cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; every stage but the last returns the columns of documents."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
