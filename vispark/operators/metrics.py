"""Evaluation as aggregations over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vispark.sources.staging import staged


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows (wrong, want, got) -> tp, fp, fn, precision, recall, f1.

    A wrong token that was changed to something else counts as missed and as a false fix.
    """
    error, touched = F.col("wrong") != F.col("want"), F.col("got") != F.col("wrong")
    right = F.col("got") == F.col("want")
    out = rows.groupBy(*(by or [])).agg(
        F.count_if(error & right).alias("tp"),
        F.count_if(touched & ~(error & right)).alias("fp"),
        F.count_if(error & ~right).alias("fn"),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def outcome(rows: DataFrame) -> DataFrame:
    """rows (wrong, want, got) with outcome: fixed, missed, wrong_fix, false_alarm or clean."""
    error, touched = F.col("wrong") != F.col("want"), F.col("got") != F.col("wrong")
    kind = (
        F.when(error & (F.col("got") == F.col("want")), "fixed")
        .when(error & touched, "wrong_fix")
        .when(error, "missed")
        .when(touched, "false_alarm")
        .otherwise("clean")
    )
    return rows.withColumn("outcome", kind)


def sentence_buckets(rows: DataFrame, key: str) -> DataFrame:
    """errors (4 stands for more), bucket, n of the sentences with an error.

    wrong_edit: something was changed that should not have been, or wrongly; clean: every error is fixed; scope_fixed: as many as there are
    errors in scope (rows: in_scope); partly: some; untouched: none.
    """
    marked = outcome(rows)
    per = marked.groupBy(key).agg(
        F.count_if(F.col("wrong") != F.col("want")).alias("errors"),
        F.count_if((F.col("wrong") != F.col("want")) & F.col("in_scope")).alias("inside"),
        *[F.count_if(F.col("outcome") == k).alias(k) for k in ("fixed", "missed", "wrong_fix", "false_alarm")],
    )
    bucket = (
        F.when((F.col("wrong_fix") > 0) | (F.col("false_alarm") > 0), "wrong_edit")
        .when(F.col("missed") == 0, "clean")
        .when((F.col("inside") > 0) & (F.col("fixed") == F.col("inside")), "scope_fixed")
        .when(F.col("fixed") > 0, "partly")
        .otherwise("untouched")
    )
    per = per.where("errors > 0").select(F.least("errors", F.lit(4)).alias("errors"), bucket.alias("bucket"))
    return per.groupBy("errors", "bucket").agg(F.count("*").alias("n"))


def false_alarms(rows: DataFrame, source: str, sentence: str) -> DataFrame:
    """Clean rows (source, sentence, fires) -> sentences, words, alarms, hit_sentences and their share, by source."""
    per = rows.groupBy(source, sentence).agg(F.count("*").alias("words"), F.count_if("fires").alias("alarms"))
    out = per.groupBy(source).agg(
        F.count("*").alias("sentences"), F.sum("words").alias("words"), F.sum("alarms").alias("alarms"), F.count_if(F.col("alarms") > 0).alias("hit_sentences")
    )
    return out.withColumn("hit_share", F.col("hit_sentences") / F.col("sentences"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two sets of results (keys, result) -> same, changed, only_a, only_b, delta, se.

    se is the standard error of the difference of shares, from the discordant keys.
    """
    both = a.select(*keys, F.col("result").alias("ra")).join(b.select(*keys, F.col("result").alias("rb")), keys, "full_outer")
    out = both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ra") == F.col("rb")).alias("same"),
        F.count_if(F.col("ra") != F.col("rb")).alias("changed"),
        F.count_if(F.col("rb").isNull()).alias("only_a"),
        F.count_if(F.col("ra").isNull()).alias("only_b"),
    )
    return out.withColumn("delta", F.col("only_b") - F.col("only_a")).withColumn("se", F.sqrt(F.col("only_a") + F.col("only_b")) / F.col("n"))


# Rules that give the index (from 0) of a quantile among n ordered values.
INDEX_RULES = {
    "floor": lambda n, q: F.least(n - 1, F.floor(n * q)),
    "before": lambda n, q: F.pmod(F.floor(n * q) - 1, n),  # the one before; below the first, the last
    "ceil": lambda n, q: F.greatest(F.ceil(n * q) - 1, F.lit(0)),
}


def order_statistics(rows: DataFrame, value: str, by: list[str], picks: dict[str, tuple[str, float]]) -> DataFrame:
    """by, n and, for each name of picks, the quantile of a rule: linear (between the two nearest values) or one of INDEX_RULES.

    Values are put into ranges over (by, value), so that no task has a whole group; the values in each range are counted, and a rank is
    looked up in its range.  Null values do not count; groups of nulls alone are left out.
    """
    groups = [F.col(c) for c in by]
    order = [*by, value]
    ranges = rows.where(F.col(value).isNotNull()).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    # After the sort, ids within a partition go up by one.
    ranges = staged(ranges.select(*order, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "ranges")
    sizes = ranges.groupBy(*by, "_part").agg(F.count("*").alias("_count"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).withColumn("n", F.sum("_count").over(Window.partitionBy(*by)))
    n, wanted = F.col("n"), []
    for name, (rule, q) in picks.items():
        at = (n - 1) * F.lit(q) if rule == "linear" else INDEX_RULES[rule](n, F.lit(q)).cast("double")
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("share")))
    asked = sizes.select(*by, "_part", "_count", "_first", "_before", "n", F.inline(F.array(*wanted)))
    asked = asked.where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_count")))
    asked = asked.select(*by, "n", "name", "side", "share", (F.col("_first") + F.col("rank") - F.col("_before")).alias("_id"))
    found = asked.join(ranges.select("_id", F.col(value).cast("double").alias("_value")), "_id")
    pick = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_value")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    between = lambda name: pick(name, "lo") * (1 - share(name)) + pick(name, "hi") * share(name)
    return found.groupBy(*groups, "n").agg(*[between(name).alias(name) for name in picks])


def quantiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, median, p75, p90 by interpolation, and p50, p95, p99 by the value at index min(n - 1, floor(n q))."""
    linear = {name: ("linear", q) for name, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
    return order_statistics(rows, value, by, linear | {name: ("floor", q) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))})
