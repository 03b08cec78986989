"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

toxicity (documents rated toxic go), exact dedup, n-gram Jaccard join (one document of each group stays),
mixing sources to target weights (documents repeat by epoch), best-fit packing.

Each stage takes any columns beside doc_id, text and source, whatever their names, and all but the last return all columns as
they were.  A null text counts as empty and a null source as a source of its own; rows with a null doc_id, or with the same
one, are judged one by one.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vispark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from vispark.llm.common import delete_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on this corpus's labels, does not rate toxic; empty texts stay."""
    model = toxicity.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id; null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one that names it; documents without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids; a document that the mix repeats is packed as often."""
    return packing.pack_documents(docs, length=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Model scores and byte-pair encoding have no SQL form; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete_path(spark, last)
        last = path
    return docs
