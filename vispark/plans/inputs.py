"""Inputs of the queries, from the driver's tables.

No table holds Vietnamese text or model logits.  Rule queries therefore run over documents with rule_texts added, and
decision queries over logits that a hash makes of document and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vispark.functions import text as tx
from vispark.operators import corpus
from vispark.plans.rule_texts import rule_texts
from vispark.sources.staging import staged


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return tx.token_rows(docs(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lower-case words with their counts."""
    return tokens(spark, d).groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("n"))


def written_options(spark: SparkSession, d: str) -> DataFrame:
    """word, broken, fix: how words that occur 20 times, in any case, can be broken; words as written, as a tag keeps the case.

    Words are counted as written once, and staged: the lexicon is made of these counts.
    """
    written = staged(tokens(spark, d).groupBy(F.col("tok").alias("word")).agg(F.count("*").alias("n")), "written")
    known = written.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).where("n >= 20").select("word")
    return corpus.corruptions(written, known).select("word", "broken", "fix")


def rule_docs(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(rule_texts())], "doc_id long, text string")
    return docs(spark, d).select("doc_id", "text").unionByName(extra)


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """pairs with n, the tokens of the document; made within the document's row, without an exchange.

    Hashes are generated, so that filters on what comes of them do not compute them anew.
    """
    rows = tx.apart(docs(spark, d), _toks=tx.tokens(F.col("text")))
    n = F.size("_toks")
    less = F.greatest(n - 1, F.lit(0))
    both = F.arrays_zip(F.slice("_toks", F.lit(1), less).alias("prev"), F.slice("_toks", F.lit(2), less).alias("tok"))
    rows = rows.select("doc_id", n.alias("n"), F.posexplode(both).alias("pos", "p")).select("doc_id", "n", (F.col("pos") + 1).alias("pos"), "p.prev", "p.tok")
    swapped = tx.hash_below(0.2, 3, F.col("doc_id"), F.col("pos"))
    rows = tx.apart(rows, wrong=F.lower(F.when(swapped, F.col("prev")).otherwise(F.col("tok"))), want=F.lower("tok"))
    return rows.select("doc_id", "pos", "wrong", "want", "n")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring tokens as (wrong, want) pairs: a token is an error where its hash is small."""
    return pair_rows(spark, d).drop("n")


def with_got(rows: DataFrame, seed: int, name: str = "got") -> DataFrame:
    """pairs with what is predicted: right for most errors, and now and then a change where none is due."""
    rows = tx.apart(rows, _v=tx.unit_hash(seed, F.col("doc_id"), F.col("pos")))
    error, v = F.col("wrong") != F.col("want"), F.col("_v")
    out = F.when(error & (v < 0.6), F.col("want")).when(error & (v < 0.7), F.lit("?")).when(~error & (v < 0.01), F.lit("?"))
    return rows.withColumn(name, F.coalesce(out, F.col("wrong"))).drop("_v")


def predicted(spark: SparkSession, d: str, seed: int = 9) -> DataFrame:
    """pairs with got."""
    return with_got(pairs(spark, d), seed)


#: The tags of logits, the same in all rows.
LOGIT_TAGS = ("KEEP", "TONE_HOI", "CH_TR", "N_NG")


def logits(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, tok, lower, tags, logits: four tags for each token, by hash."""
    rows = tokens(spark, d)
    x = [tx.unit_hash(20 + i, F.col("doc_id"), F.col("pos")) * 8.0 for i in range(len(LOGIT_TAGS))]
    return rows.select("doc_id", "pos", "tok", "lower", F.array(*[F.lit(t) for t in LOGIT_TAGS]).alias("tags"), F.array(*x).alias("logits"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Issues of one to three tokens that start at hashed tokens, with a hashed confidence."""
    at = F.col("doc_id"), F.col("pos")
    u = lambda s: tx.unit_hash(s, *at)
    rows = tokens(spark, d).where(tx.hash_below(0.3, 40, *at))
    start, length = (F.col("pos") * 10).cast("int"), (F.floor(u(41) * 3) * 10 + 5).cast("int")
    return rows.select(
        "doc_id", start.alias("start"), (start + length).alias("end"), F.round(u(42), 2).alias("confidence"),
        F.when(tx.hash_below(0.5, 43, *at), "rule").otherwise("model").alias("source"), F.col("lower").alias("suggestion"),
    )
