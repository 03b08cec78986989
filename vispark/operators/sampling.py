"""Sampling and synthetic cases.  All draws are by hash, so they depend on neither partitioning nor file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.functions.alphabet import FINAL_TAGS, INITIAL_TAGS
from vispark.functions.syllable import candidate_rows
from vispark.functions.text import apart, unit_hash
from vispark.operators.corpus import tags_between
from vispark.operators.windows import chain, how_many, let, with_offsets

CONSONANT_TAGS = (*INITIAL_TAGS, *FINAL_TAGS)
#: Rows at the cut of a sample that are ordered rather than counted again.
AT_CUT = 10_000


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 13) -> DataFrame:
    """n rows without replacement, those with the smallest hashes, of equals the smallest keys; an error if there are fewer.

    Histograms of the hash find the cut, at most 4,096 counts at a time; a last pass keeps what is below it.  Nothing is ordered but the few rows at the cut.
    """
    hashed = rows.withColumn("_h", (unit_hash(seed, F.col(key)) * float(2**32)).cast("long"))
    low, have, shift = 0, 0, 32
    while shift:
        width, shift = shift, max(shift - 12, 0)
        inside = hashed.where((F.col("_h") >= low) & (F.col("_h") < low + 2**width))
        counts = dict(inside.groupBy(F.shiftright(F.col("_h") - low, shift).alias("b")).agg(F.count("*")).collect())
        if width == 32 and sum(counts.values()) < n:
            raise ValueError(f"{n} rows are asked for, of {sum(counts.values())}")
        if have + sum(counts.values()) == n:  # all of them
            low += 2**width
            have = n
            break
        for bucket in sorted(counts):
            if have + counts[bucket] > n:
                low += bucket << shift
                break
            have += counts[bucket]
        if counts[bucket] <= AT_CUT:
            break
    below, edge = hashed.where(F.col("_h") < low), hashed.where((F.col("_h") >= low) & (F.col("_h") < low + 2**shift))
    return (below.unionByName(edge.orderBy("_h", key).limit(n - have)) if n > have else below).drop("_h")


def mixed_pools(pools: dict[str, tuple[DataFrame, int]], key: str, seed: int = 13) -> DataFrame:
    """pool, and the columns of the pools: so many rows of each, in one shuffled order."""
    out = None
    for name, (rows, n) in pools.items():
        some = sample_rows(rows, key, n, seed).withColumn("pool", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out.orderBy(unit_hash(seed + 1, F.col("pool"), F.col(key)), "pool", key)


def variants(rows: DataFrame, split: str, k: int) -> DataFrame:
    """Each row of the training split k times, others once, with variant from 1."""
    times = F.when(F.col(split) == "train", k).otherwise(1)
    return rows.withColumn("variant", F.explode(F.sequence(F.lit(1), times)))


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; by empty: of all."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def assembled(targets: DataFrame, clean: DataFrame, per_doc: int = 4, joint: str = ". ") -> DataFrame:
    """targets (k from 0, sentence), clean (k from 0, sentence) -> doc, text, parts: documents of clean, target, clean, per_doc times.

    parts has each sentence's kind, begin and stop in the text.  The clean sentences go round, thirteen apart.
    """
    n = clean.agg(F.count("*").alias("_n"))
    slots = targets.select(F.floor(F.col("k") / per_doc).alias("doc"), "k", F.col("sentence").alias("target")).crossJoin(F.broadcast(n))
    slots = slots.select("doc", "k", "target", *[F.pmod((2 * F.col("k") + i) * 13 + 101, F.col("_n")).alias(f"c{i}") for i in (0, 1)])
    pick = lambda i: clean.select(F.col("k").alias(f"c{i}"), F.col("sentence").alias(f"s{i}"))
    rows = slots.join(pick(0), "c0").join(pick(1), "c1")
    three = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("sentence")) for kind, c in (("clean", "s0"), ("target", "target"), ("clean", "s1"))])
    docs = rows.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", three.alias("p")))), lambda x: x["p"])).alias("p"))
    begin = F.lit(0)
    step = lambda a, x: F.array_append(a, F.struct(x["kind"].alias("kind"), F.coalesce(F.try_element_at(a, F.lit(-1))["stop"] + len(joint), begin).alias("begin"), (F.coalesce(F.try_element_at(a, F.lit(-1))["stop"] + len(joint), begin) + F.length(x["sentence"])).alias("stop")))
    parts = F.aggregate("p", F.array().cast("array<struct<kind: string, begin: int, stop: int>>"), step)  # per_doc * 3 parts
    return docs.select("doc", F.array_join(F.transform("p", lambda x: x["sentence"]), joint).alias("text"), parts.alias("parts"))


EDITS = ("append", "replace", "delete", "insert", "swap")


def edited(words: Column, kind: str, at: Column, new: Column) -> Column:
    """Words after an edit at a place from 0: new behind all, in place of the word, before it; or the word deleted or put behind the next."""
    place = F.when(F.size(words) > 0, F.pmod(at, F.size(words))).otherwise(0)
    head, tail = F.slice(words, F.lit(1), place), lambda skip: F.slice(words, place + 1 + skip, F.size(words))
    return {
        "append": F.array_append(words, new),
        "replace": F.concat(head, F.array(new), tail(1)),
        "delete": F.concat(head, tail(1)),
        "insert": F.concat(head, F.array(new), tail(0)),
        "swap": F.concat(head, F.slice(words, place + 2, F.lit(1)), F.slice(words, place + 1, F.lit(1)), tail(2)),
    }[kind]


def middle(words: Column) -> Column:
    """The word in the middle, of an even number the right one; null of none."""
    return F.get(words, F.floor(F.size(words) / 2).cast("int"))


def every_kth(words: Column, k: int) -> Column:
    return F.filter(words, lambda _, i: i % k == 0)


def confusions(words: DataFrame, known: DataFrame) -> DataFrame:
    """word -> word, bad, tag: known words that a consonant tag makes of a known word, with the consonant tag that leads back."""
    names = known.select(F.col("word").alias("_known"))
    own = words.select("word").distinct().join(names, F.lower("word") == F.col("_known"), "left_semi")
    made = candidate_rows(own).where(F.col("tag").isin(*CONSONANT_TAGS)).select("word", F.col("result").alias("bad")).distinct()
    made = made.join(names, F.lower("bad") == F.col("_known"), "left_semi")
    back = tags_between(made.select(F.col("bad").alias("src"), F.col("word").alias("dst")), known)
    return back.where(F.col("tag").isin(*CONSONANT_TAGS)).select(F.col("dst").alias("word"), F.col("src").alias("bad"), "tag")


def _chunk_starts(rows: DataFrame, budget: int) -> DataFrame:
    """rows (counts) with _starts: where each chunk begins, and last how many counts there are; chunks follow each other and end before what would overfill them."""
    rows = with_offsets(rows)
    offs, n = F.col("_offs"), F.size("counts")
    following = lambda i: F.greatest(i + 1, let(F.get(offs, i), lambda begin: how_many(offs, lambda o: o <= begin + budget) - 1))
    return apart(rows, _starts=F.array_append(chain(following, n), n)).drop("_offs")


def packed_chunks(rows: DataFrame, budget: int = 94) -> DataFrame:
    """rows (counts) with chunk, each word's chunk: words follow each other, and a chunk ends before the word that would overfill it."""
    rows = _chunk_starts(rows, budget)
    chunk = F.transform(F.slice("_starts", F.lit(1), F.size("_starts") - 1), lambda s, k: F.array_repeat(k, F.get("_starts", k + 1) - s))
    return rows.withColumn("chunk", F.flatten(chunk)).drop("_starts")


def packed_sentences(rows: DataFrame, budget: int = 94) -> DataFrame:
    """rows (sentences, counts: their pieces) with chunks: whole sentences, joined by blanks, as many as fit; one that is too long is alone."""
    rows = _chunk_starts(rows, budget)
    text = lambda s, k: F.array_join(F.slice("sentences", s + 1, F.get("_starts", k + 1) - s), " ")
    return rows.withColumn("chunks", F.transform(F.slice("_starts", F.lit(1), F.size("_starts") - 1), text)).drop("_starts")
