"""Issues as spans of a document: removing overlaps, and merging two sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.functions.text import apart
from vispark.operators.windows import chain, how_many, let


#: Positions of a document that make up a bin: spans meet by (document, bin), so a long document is many tasks.
BIN = 4096


def without_overlaps(rows: DataFrame) -> DataFrame:
    """rows with `all`, an array of (by, it), ordered -> a row with x for each that starts where the last kept one has ended.

    From each kept issue the next is found by binary search, so what is left out costs nothing.
    """
    rows = apart(rows, _starts=F.transform("all", lambda x: x["it"]["start"].cast("long")), _ends=F.transform("all", lambda x: x["it"]["end"].cast("long")))
    following = lambda i: F.greatest(i + 1, let(F.get("_ends", i), lambda end: how_many(F.col("_starts"), lambda s: s < end)))
    rows = apart(rows, _kept=chain(following, F.size("all")))
    return rows.select("*", F.explode(F.transform("_kept", lambda i: F.get("all", i))).alias("x")).drop("all", "_starts", "_ends", "_kept")


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """Keeps, from the left, each issue that starts where the last kept one has ended.

    Of issues with one start the longest comes first, then the most confident, then the one with the smaller source and
    suggestion.  One aggregation by document; what follows runs over that document's issues only.
    """
    columns = [c for c in issues.columns if c != "doc_id"]
    order = F.struct("start", (-F.col("end")).alias("short"), (-F.col("confidence")).alias("doubt"), "source", "suggestion")
    rows = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("by"), F.struct(*columns).alias("it")))).alias("all"))
    return without_overlaps(rows).select("doc_id", "x.it.*").select(*issues.columns)


def binned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with _bin, a row for each bin that a span (end exclusive) touches; an empty span is in the bin of its place."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(last / BIN))))


def rule_first(issues: DataFrame, is_rule: Column) -> DataFrame:
    """The issues (doc_id, start, end, and more) for which is_rule holds, and of the others those that overlap none of them; start must not exceed end.

    Issues meet once, by (document, bin), in the order of their starts: what starts no later than an issue overlaps it if it ends behind its
    start, and what starts later if that is before its end.  So the farthest end until there and the next start tell, and no pairs are made.
    An empty issue overlaps nothing that starts where it does, so it goes before that.  Only issues in several bins are brought together again.
    """
    first, last = F.floor(F.col("start") / BIN), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / BIN)
    rows = issues.withColumn("_bin", F.explode_outer(F.sequence(first, last))).repartition("doc_id", "_bin")  # what follows is made behind the exchange
    rows = rows.withColumns({"_first": first, "_last": last, "_rule": F.coalesce(is_rule, F.lit(False))})
    rows = rows.withColumn("_order", F.when(F.col("_rule"), 1).when(F.col("start") < F.col("end"), 2).otherwise(0))
    rows = rows.withColumn("_from", F.when(F.col("_rule") & F.col("end").isNotNull(), F.col("start")))
    near = "OVER (PARTITION BY doc_id, _bin ORDER BY start, _order"
    rows = rows.withColumns({
        "_reached": F.expr(f"max(CASE WHEN _rule THEN end END) {near} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        "_next": F.expr(f"lead(_from) IGNORE NULLS {near})"),
    })
    touched = F.col("doc_id").isNotNull() & F.col("end").isNotNull() & ((F.col("_reached") > F.col("start")) | (F.col("_next") < F.col("end")))
    rows = rows.withColumn("_hit", ~F.col("_rule") & F.coalesce(touched, F.lit(False)))
    once, several = F.coalesce(F.col("_bin") == F.col("_first"), F.lit(True)), F.coalesce(F.col("_first") < F.col("_last"), F.lit(False))
    alone = rows.where(once & (F.col("_rule") | ~several) & ~F.col("_hit"))
    spread = rows.where(several & ~F.col("_rule")).withColumn("_hit", F.max("_hit").over(Window.partitionBy("doc_id", "start", "end")))
    return alone.unionByName(spread.where(once & ~F.col("_hit"))).select(*issues.columns)


def merge_rule_first(rules: DataFrame, model: DataFrame) -> DataFrame:
    """All rule issues, and the model's that overlap none of them; where both come from one table, rule_first reads it once."""
    marked = rules.withColumn("_of_rules", F.lit(True)).unionByName(model.withColumn("_of_rules", F.lit(False)))
    return rule_first(marked, F.col("_of_rules")).drop("_of_rules")


def within(places: DataFrame, at: str, ranges: DataFrame, begin: str, stop: str, document: str = "doc_id") -> DataFrame:
    """places joined with the ranges of their document in which they lie (stop exclusive), all columns of both; the others stay, with nulls."""
    some = binned(ranges.withColumnRenamed(document, "_doc").where(F.col(stop) > F.col(begin)), begin, stop).withColumnRenamed("_bin", "_at")
    inside = (F.col(document) == F.col("_doc")) & (F.floor(F.col(at) / BIN) == F.col("_at")) & (F.col(begin) <= F.col(at)) & (F.col(at) < F.col(stop))
    return places.join(some, inside, "left").drop("_doc", "_at")


def hits_in_ranges(issues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Issues joined with the ranges (doc_id, begin, stop, and more) in which they start; unmatched ones stay, with nulls."""
    return within(issues, "start", ranges, "begin", "stop")
