"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Each text is cut where its own content says so, each chunk is named by its SHA-256, and a
document becomes the ordered list of its chunks' names: its recipe.  A name counts only
once it is verified: all chunks that bear it are compared byte by byte, for which each distinct chunk
moves once for each task that holds it.  After that no text moves any more; equal recipes
are equal texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.llm.common import SPACES, keep_marked, staged, whole_text

MIN_CHUNK, MAX_CHUNK = 384, 4096
#: A cut falls behind the blank in these surroundings, once a chunk is long enough.
CUT = "[aeiou][a-m] (?=[a-m])"


def chunks(text: Column) -> Column:
    """Content-defined chunks whose concatenation is the text; empty for an empty text."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{CUT})|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sha256_name(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def exact_duplicates(docs: DataFrame, name: Callable[[Column], Column] = sha256_name) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty.  keep_id is the group's smallest doc_id (null only if all are), and exactly one row of
    a group is kept, also where rows repeat.  An empty table gives no rows; other columns are ignored.
    name: gives a chunk's name; where two different chunks share one, their documents are
    compared by whole text instead.
    """
    text = F.regexp_replace(whole_text(docs), SPACES, " ")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("norm"))
    cut = base.select("doc_id", "norm", chunks(F.col("norm")).alias("chunks"))
    recipes = staged(
        cut.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("chunks", name).alias("recipe"),
        ),
        "recipes",
    )
    distinct = cut.select(F.explode("chunks").alias("chunk")).distinct()
    named = distinct.select(name(F.col("chunk")).alias("name"))
    clashes = staged(named.groupBy("name").agg(F.count("*").alias("texts")).where("texts > 1").select("name"), "clashes")
    if clashes.isEmpty():
        recipes = recipes.withColumn("whole", F.lit(None).cast("string"))
    else:
        doubtful = cut.select("norm", F.explode("chunks").alias("chunk")).select("norm", name(F.col("chunk")).alias("name"))
        doubtful = doubtful.join(clashes, "name", "left_semi").select("norm").distinct()
        doubtful = doubtful.select(F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("whole"))
        recipes = staged(recipes.join(doubtful, "text_sha256", "left"), "recipes")
    key = F.struct("recipe", F.coalesce("whole", F.lit("")).alias("whole"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = staged(
        recipes.groupBy(key.alias("key")).agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups"
    )
    return (
        recipes.withColumn("key", key)
        .join(groups, "key", "left")
        .select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns; of repeated rows, one stays."""
    marks = exact_duplicates(docs).select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return keep_marked(docs, marks, F.sha2(F.regexp_replace(whole_text(docs), SPACES, " "), 256))
