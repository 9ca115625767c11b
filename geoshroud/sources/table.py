"""Coordinates and attributes as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame) -> DataFrame:
    """Values that a text format takes: numbers, texts and booleans as they are, everything else as JSON text."""
    out = []
    for name, kind in df.dtypes:
        nested = kind.startswith(("array", "map", "struct"))
        out.append(F.to_json(name).alias(name) if nested else F.col(name).cast("string").alias(name) if kind in ("binary", "date", "timestamp") else F.col(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """One file a task, each with a header."""
    as_text(df).write.mode("overwrite").option("header", True).csv(path)
