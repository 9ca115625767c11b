"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(spark, _read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(spark, _read(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, _read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_of

    return license_of(spark, _read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(spark, _read(spark, sf_dir, "documents"), k=4, pct=85)


def op6_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_links

    return jaccard_links(spark, _read(spark, sf_dir, "documents"), k=4, pct=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_spans

    return dedup_spans(spark, _read(spark, sf_dir, "documents"), with_text=True, text_n=200)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict

    return predict(spark, _read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest

    return digest(spark, _read(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_decontamination, op3_url_filter, op4_packing, op5_license_scan, op6_ngram_jaccard_join, op7_suffix_dedup, op8_language_id, op9_chat_format, op10_toxicity,
        op6_ngram_jaccard_links,
    )
}
