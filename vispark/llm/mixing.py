"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Each source gets a budget of words.  As many complete epochs as fit come first; the rest is
drawn without replacement: each document gets the key -ln(u) / weight, u from a hash and
the weight from its quality, and the smallest keys are taken until the budget is reached.
The order within a source is made by range partitions over (source, key), so that a
source with a third of all rows is sorted and summed by many tasks: a running sum within each range,
plus the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.llm.common import WORDS, maybe_broadcast, staged, whole_row, whole_text

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Budget of the mix as a share of all words.
SHARE = 1.5
#: A source is repeated so often at most.
MAX_EPOCHS = 2
#: Characters of markup and noise; the more of them, the lower the quality weight.
NOISE = "#$%&*|~^<>{}[]!"


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters that are not noise, to the eighth power; 1 for no text."""
    share = F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.pow(share, F.lit(8.0))))


def uniform(seed: int, *columns: Column) -> Column:
    """In (0, 1), from a hash: the same on every run and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_key(docs: DataFrame) -> Column:
    """Sources in code-point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), docs["source"].cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """skey, source_size -> skey, source_size, target: budgets by weight, stopped at max_epochs times the size.

    The excess of the stopped sources is shared anew by weight until none is above.  As shares only grow,
    the stopped ones are those with the smallest ratio of limit to weight, so one sorted pass finds them.  One task makes it, over
    one row for each source: fit for some millions of sources, whatever the size of the corpus.
    """
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(max_epochs))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = (
        limits.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("open", F.col("limit") / F.col("weight") >= F.col("level"))
    )
    final = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "skey", "level"))).over(everything)
    return levels.withColumn("final", final["level"]).select(
        "skey",
        "source_size",
        F.when(F.col("final").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("weight") * F.col("final")))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, times, text_hash, skey.

    size counts the words of the whole text (null: 0).  times is the number of the
    source's complete epochs, plus one for the documents that the fractional draw selects: those with the smallest keys,
    up to the prefix whose sum is nearest to the rest of the budget; taken is times * size.  A null source is
    a source of its own and the last.  Ties of the key break by doc_id and text hash; repeated rows count as separate
    documents.  Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source_key(docs).alias("skey"), whole_text(docs).alias("text"))
    draw = -F.log(uniform(seed, F.col("doc_id"), F.col("skey"), F.col("size"))) / quality_weight(F.col("text"))
    sized = base.withColumn("size", n_words(F.col("text")))
    sized = sized.select("doc_id", "skey", "size", draw.alias("key"), F.xxhash64("text").alias("text_hash"))
    sized = staged(sized, "mix_sizes")
    order = ["skey", "key", "doc_id", "text_hash"]
    ranges = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = staged(ranges.withColumn("part", F.spark_partition_id()), "mix_order")
    sums = ranges.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    sizes = sums.groupBy("skey").agg(F.sum("part_size").alias("source_size"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = (
        sums.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
        .join(source_targets(sizes, share, weights, max_epochs), "skey")
        .drop("part_size")
    )
    per_part = staged(per_part, "mix_offsets")
    within = Window.partitionBy("skey", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    middle = F.col("offset") + F.col("running") - F.col("size") / 2
    drawn = (F.col("rest") > 0) & (middle <= F.col("rest"))
    return (
        ranges.withColumn("running", F.sum("size").over(within))
        .join(per_part, ["skey", "part"])
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("times", (F.col("epochs") + F.when(drawn, 1).otherwise(0)).cast("int"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("times") * F.col("size")).cast("long").alias("taken"),
            "times",
            "text_hash",
            "skey",
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows are told apart by doc_id (null is one of its own), source and text.  Of repeated rows some may be taken once
    more than the others; which ones, a fixed order of their other columns decides.  The documents
    move only where the table of their counts is too long for a broadcast.
    """
    keys = ["_k0", "_k1", "_k2", "_k3"]
    times = mix(docs, **options).groupBy(
        F.col("doc_id").isNull().alias("_k0"), F.coalesce("doc_id", F.lit(0)).alias("_k1"), F.col("text_hash").alias("_k2"), F.col("skey").alias("_k3")
    )
    per = staged(times.agg(F.count("*").alias("_n"), F.sum("times").alias("_total"), F.min("times").alias("_times")).where("_total > 0"), "mix_times")
    id_ = docs["doc_id"].cast("long")
    rows = docs.select(
        whole_row(docs).alias("row"), id_.isNull().alias("_k0"), F.coalesce(id_, F.lit(0)).alias("_k1"), F.xxhash64(whole_text(docs)).alias("_k2"), source_key(docs).alias("_k3")
    )
    even, uneven = per.where("_total = _n * _times"), per.where("_total > _n * _times")
    taken = rows.join(maybe_broadcast(even.select(*keys, "_times")), keys).select("row", "_times")
    if not uneven.isEmpty():
        some = rows.join(maybe_broadcast(uneven.withColumn("_more", F.col("_total") - F.col("_n") * F.col("_times"))), keys)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.to_json("row")))
        some = some.withColumn("_rank", rank).select("row", (F.col("_times") + (F.col("_rank") <= F.col("_more")).cast("int")).alias("_times"))
        taken = taken.unionByName(some.where("_times > 0"))
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1), "_times"))).select("row.*")
