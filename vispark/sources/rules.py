"""Rule tables from files: the homophone pairs are data, and may be replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIRS = (
    "entry int, tag string, form string, gloss string, strict boolean, other string, other_gloss string, "
    "before array<string>, after array<string>, other_before array<string>, other_after array<string>"
)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pair table of vispark.operators.rules from JSON lines."""
    return spark.read.schema(PAIRS).json(path)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """The phrase table: key, n (its words), right, tag, why from JSON lines."""
    return spark.read.schema("key string, n int, right string, tag string, why string").json(path)
