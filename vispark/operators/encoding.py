"""Byte-pair encoding of words, inputs of a model from it, and a vocabulary cut down to what a corpus uses."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vispark.sources.staging import staged

# The end of a word while merging, what marks a piece that goes on, the label of positions without one.
WORD_END, GOES_ON, NO_LABEL = "</w>", "@@", -100
MAX_PIECES = 96


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """rank, left, right from lines of `left right count`; a line that begins with #version is left out."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("rank", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = rows.where(~F.startswith("line", F.lit("#version")) & (F.size(parts) >= 2))
    return rows.select("rank", parts[0].alias("left"), parts[1].alias("right"))


def write_tokenizer(vocabulary: DataFrame, merges: DataFrame, path: str) -> None:
    """One JSON object of the vocabulary (piece, id) and the merges in their order; both are as small as a vocabulary."""
    words = vocabulary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("piece", "id")))).alias("vocab"))
    ordered = merges.agg(F.array_sort(F.collect_list(F.struct("rank", "left", "right"))).alias("m"))
    pairs = F.transform("m", lambda x: F.concat_ws(" ", x["left"], x["right"]))
    words.crossJoin(ordered).select(F.to_json(F.struct(F.struct(F.lit("BPE").alias("type"), "vocab", pairs.alias("merges")).alias("model"))).alias("value")).coalesce(1).write.text(path)


def read_tokenizer(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of such a file."""
    raw = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one vocabulary
    model = json.loads(raw)["model"]
    if model.get("type", "BPE") != "BPE":
        raise ValueError(f"not a BPE model: {model['type']}")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return model["vocab"], pairs


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of a word: the pair of the lowest rank is merged, of equals the leftmost, until none is known.

    Pairs wait in a heap by rank and place, pieces are linked with their neighbours; an entry whose pair has changed is passed over.
    """
    parts: list[str | None] = [*word[:-1], word[-1] + WORD_END] if word else []
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    heapq.heapify(waiting)
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (again := ranks.get((parts[left], parts[after[left]]))) is not None:
                heapq.heappush(waiting, (again, left))
    left = [p for p in parts if p is not None]
    return [p + GOES_ON for p in left[:-1]] + [p[: -len(WORD_END)] for p in left[-1:]]


def word_pieces(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """word -> word, pieces: each distinct word once, by an Arrow function; the merges go with it, as long as a vocabulary."""
    ranks = {pair: i for i, pair in enumerate(merges)}

    @F.pandas_udf("array<string>")
    def pieces(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in column:
            yield some.map(lambda w: merge_word(w, ranks))

    return words.where("word is not null").select("word").distinct().withColumn("pieces", pieces("word"))


def within_reach(words: Column, max_pieces: int = MAX_PIECES) -> Column:
    """The words that an input of max_pieces can have: each takes one piece at least, so none behind these ever fits between bos and eos."""
    return F.slice(words, F.lit(1), F.lit(max(max_pieces - 2, 0)))


def encode_words(sentences: DataFrame, pieces: DataFrame, max_pieces: int = MAX_PIECES, bos: int = 0, eos: int = 2, unknown: int = 3) -> DataFrame:
    """key, words and more; word, ids -> the same with ids, word_ids, first: a model's input.

    Words are taken while they fit whole between bos and eos; the first that does not ends the sentence.  word_ids has each
    piece's word (-1: bos and eos), first each word's first piece (-1: cut off).  A word without ids is the unknown one.
    Only words within reach are looked up, and what is not asked for of words and more does not travel.
    """
    each = sentences.select("key", F.posexplode(within_reach(F.col("words"), max_pieces)).alias("pos", "word"))
    known = each.join(pieces.select("word", "ids"), "word", "left")
    ids = F.when(F.coalesce(F.size("ids"), F.lit(0)) > 0, F.col("ids")).otherwise(F.array(F.lit(unknown)))
    rows = known.select("key", "pos", ids.alias("ids"))
    before = F.sum(F.size("ids")).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", before).where(F.col("end") <= max_pieces - 2)
    kept = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "end"))).alias("w"))
    out = sentences.withColumn("_n", F.size("words")).join(kept, "key", "left").withColumn("w", F.coalesce("w", F.array()))
    flat = F.flatten(F.transform("w", lambda x: x["ids"]))
    owners = F.flatten(F.transform("w", lambda x: F.array_repeat(x["pos"], F.size(x["ids"]))))
    taken = F.transform("w", lambda x: (x["end"] - F.size(x["ids"]) + 1).cast("int"))
    first = F.concat(taken, F.array_repeat(F.lit(-1), F.col("_n") - F.size("w")))  # the words that fit are the first ones
    wrapped = lambda middle, begin, stop: F.concat(F.array(F.lit(begin)), middle, F.array(F.lit(stop)))
    return out.select(*sentences.columns, wrapped(flat, bos, eos).alias("ids"), wrapped(owners, -1, -1).alias("word_ids"), first.alias("first"))


def align_labels(word_ids: Column, labels: Column) -> Column:
    """A label for each piece: the word's at its first piece, NO_LABEL elsewhere."""
    starts = lambda w, i: (w >= 0) & (F.coalesce(F.get(word_ids, i - 1), F.lit(-1)) != w)
    return F.transform(word_ids, lambda w, i: F.when(starts(w, i), F.get(labels, w)).otherwise(NO_LABEL))


def pad(values: Column, size: Column, fill: int) -> Column:
    """The array with fill behind it up to size elements."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def padded_batch(rows: DataFrame, batch: str, pad_id: int = 1) -> DataFrame:
    """rows (ids, labels) of each batch padded to its longest: ids, mask, labels."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    wide = rows.withColumn("_n", longest)
    mask = pad(F.transform("ids", lambda _: F.lit(1)), F.col("_n"), 0)
    return wide.withColumn("mask", mask).withColumn("ids", pad(F.col("ids"), F.col("_n"), pad_id)).withColumn("labels", pad(F.col("labels"), F.col("_n"), NO_LABEL)).drop("_n")


def flat_offsets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key, begin, stop: where each row's values lie in the table of all values, in the order of key.

    Ranges of keys are summed first, so that no task has more than one range of them; they are staged, as both what is summed and what is
    joined must see the same ranges.
    """
    sized = rows.select(F.col(key), F.size(values).cast("long").alias("n"))
    parts = staged(sized.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "flat_offsets")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = parts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    running = F.sum("n").over(Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("stop", running).join(F.broadcast(base), "part")
    return out.select(key, (F.col("base") + F.col("stop") - F.col("n")).alias("begin"), (F.col("base") + F.col("stop")).alias("stop"))


def id_counts(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """id, n: how often each id occurs."""
    return rows.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def trimmed_ids(vocabulary: DataFrame, counts: DataFrame, min_count: int, always: list[int]) -> DataFrame:
    """vocabulary (id) -> old, new: ids seen min_count times, and those of always, numbered anew in their old order.

    One task numbers them: a table as long as the vocabulary.
    """
    kept = vocabulary.join(counts, "id", "left").where((F.coalesce("n", F.lit(0)) >= min_count) | F.col("id").isin(*always))
    return kept.select(F.col("id").alias("old"), (F.row_number().over(Window.orderBy("id")) - 1).alias("new"))


def remap_faults(remap: DataFrame, counts: DataFrame, min_count: int) -> DataFrame:
    """fault, n: old or new ids that repeat, new ids out of the old ids' order, and used ids that are missing; all must be 0."""
    twice = lambda c: remap.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{c} repeats").alias("fault"), "n")
    order = F.lag("new").over(Window.orderBy("old"))
    unordered = remap.withColumn("_last", order).where("_last >= new").agg(F.count("*").alias("n")).select(F.lit("unordered").alias("fault"), "n")
    missing = counts.where(F.col("n") >= min_count).join(remap, counts["id"] == remap["old"], "left_anti").agg(F.count("*").alias("n"))
    return twice("old").unionByName(twice("new")).unionByName(unordered).unionByName(missing.select(F.lit("missing").alias("fault"), "n"))


def write_token_cache(rows: DataFrame, path: str) -> None:
    """ids and labels as arrays of smaller integers, in Parquet."""
    rows.select(F.col("ids").cast("array<int>"), F.col("labels").cast("array<short>")).write.parquet(path)


def read_token_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ids array<int>, labels array<short>").parquet(path)
