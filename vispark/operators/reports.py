"""Reports over predictions: scopes, outcomes by group, coverage, and results side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.functions.alphabet import to_ascii
from vispark.operators.corpus import tag_table
from vispark.operators.issues import within
from vispark.operators.metrics import confusion, order_statistics
from vispark.operators.sampling import first_rows
from vispark.sources.staging import staged


def with_scope(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (wrong, want) with tag and in_scope: whether a tag leads from one to the other, into a known word.

    Rows meet the words' tags, which are fewer than the different pairs.
    """
    table = tag_table(rows.select(F.col("wrong").alias("word")), known).withColumnsRenamed({"src": "wrong", "dst": "want"})
    tagged = rows.where("wrong is not null and want is not null").join(table, ["wrong", "want"], "left")
    tagged = tagged.withColumn("tag", F.when(F.col("wrong") == F.col("want"), "KEEP").otherwise(F.col("_tag"))).drop("_tag")
    return tagged.withColumn("in_scope", F.col("tag").isNotNull() & (F.col("tag") != "KEEP"))


def scoped_confusion(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """confusion without the errors that no tag expresses; only errors are looked up."""
    same = rows.where("wrong = want").select("wrong", "want", "got")
    errors = with_scope(rows.where("wrong <> want"), known).where("in_scope").select("wrong", "want", "got")
    return confusion(same.unionByName(errors))


def scope_report(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """errors, in_scope, ratio, other_length: of the errors out of scope those whose plain letters differ in number."""
    errors = with_scope(rows.where("wrong <> want"), known)
    longer = F.length(to_ascii(F.col("wrong"))) != F.length(to_ascii(F.col("want")))
    out = errors.agg(F.count("*").alias("errors"), F.count_if("in_scope").alias("in_scope"), F.count_if(~F.col("in_scope") & longer).alias("other_length"))
    return out.withColumn("ratio", F.when(F.col("errors") > 0, F.col("in_scope") / F.col("errors")).otherwise(0.0))


def scope_by_tag(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """tag, n: the errors in scope by the tag that repairs them."""
    return with_scope(rows.where("wrong <> want"), known).where("in_scope").groupBy("tag").agg(F.count("*").alias("n"))


def scope_examples(rows: DataFrame, known: DataFrame | None = None, n: int = 8) -> DataFrame:
    """The first n different errors out of scope."""
    out = with_scope(rows.where("wrong <> want"), known).where(~F.col("in_scope")).select("wrong", "want").distinct()
    return first_rows(out, [], ["wrong", "want"], n)


def tag_confusion(rows: DataFrame) -> DataFrame:
    """rows (gold, got: tags) -> tp, fp, fn: a wrong tag counts as both, an untouched error as missed."""
    right, fired, error = F.col("gold") == F.col("got"), F.col("got") != "KEEP", F.col("gold") != "KEEP"
    return rows.agg(F.count_if(right & error).alias("tp"), F.count_if(fired & ~right).alias("fp"), F.count_if(error & ~right).alias("fn"))


def fix_confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows (want: null if nothing is to be fixed, fixed: null if nothing was) -> tp, fp, fn.

    Every fix but the wanted one counts against precision, also where the error is out of scope.
    """
    hit = F.col("want").isNotNull() & F.col("fixed").eqNullSafe(F.col("want"))
    return rows.groupBy(*(by or [])).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("fixed").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("want").isNotNull() & ~hit).alias("fn")
    )


def _outcome_counts(rows: DataFrame, group: str, outcome: Column, kinds: tuple[str, ...]) -> DataFrame:
    """One row a group and one for all (group null), a column for each kind."""
    return rows.withColumn("_outcome", outcome).rollup(group).agg(F.count("*").alias("n"), *[F.count_if(F.col("_outcome") == k).alias(k) for k in kinds])


def confidence_outcomes(rows: DataFrame, group: str, threshold: float = 0.95, margin: float = 0.25) -> DataFrame:
    """rows (right: whether the best tag is, best_p, keep_p) -> fixed, shy (right, not sure enough), blind (wrong, not sure enough), wrong."""
    fires = (F.col("best_p") >= threshold) & (F.col("best_p") - F.col("keep_p") >= margin)
    kind = F.when(F.col("right") & fires, "fixed").when(F.col("right"), "shy").when(fires, "wrong").otherwise("blind")
    return _outcome_counts(rows, group, kind, ("fixed", "shy", "blind", "wrong"))


def diagnosis(rows: DataFrame, group: str, threshold: float = 0.95, margin: float = 0.25) -> DataFrame:
    """rows (gold, tags, best, best_p, keep_p) -> caught, below (right, not sure enough), wrong_tag, no_candidate."""
    fires = (F.col("best_p") >= threshold) & (F.col("best_p") - F.col("keep_p") >= margin)
    right = F.col("best") == F.col("gold")
    kind = F.when(~F.array_contains("tags", F.col("gold")), "no_candidate").when(~F.coalesce(right, F.lit(False)), "wrong_tag").when(fires, "caught").otherwise("below")
    return _outcome_counts(rows, group, kind, ("caught", "below", "wrong_tag", "no_candidate"))


def outcomes_by_group(rows: DataFrame, group: str) -> DataFrame:
    """rows (outcome) -> one row a group and one for all, a column for each outcome."""
    return _outcome_counts(rows, group, F.col("outcome"), ("fixed", "missed", "wrong_fix", "false_alarm", "clean"))


def above_cuts(rows: DataFrame, value: str, by: str, cuts: tuple[float, ...] = (0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """median, p75, p90 by interpolation, and how many values reach each cut (at_80 for 0.8).

    A few groups may have all rows, so the quantiles come from ranges of ranks.  Values are staged, as they are read three times.
    """
    values = staged(rows.select(by, value), "cuts")
    at = [f"at_{round(100 * c)}" for c in cuts]
    counts = values.groupBy(by).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= c).alias(name) for c, name in zip(cuts, at)])
    picks = {name: ("linear", p) for name, p in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
    stats = order_statistics(values, value, [by], picks).select(F.col(by).alias("_by"), *picks)
    return counts.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", *picks, *at)


def candidate_alarms(rows: DataFrame, source: str, sentence: str) -> DataFrame:
    """Clean rows (candidates: how many tags fit, fires) -> sentences, words, with_candidates, alarms, hit_sentences, and their rates."""
    per = rows.groupBy(source, sentence).agg(F.count("*").alias("words"), F.count_if(F.col("candidates") > 1).alias("cands"), F.count_if("fires").alias("alarms"))
    out = per.groupBy(source).agg(
        F.count("*").alias("sentences"), F.sum("words").alias("words"), F.sum("cands").alias("with_candidates"), F.sum("alarms").alias("alarms"), F.count_if(F.col("alarms") > 0).alias("hit_sentences")
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("by_sentence", rate("hit_sentences", "sentences")).withColumn("by_word", rate("alarms", "words")).withColumn("by_candidate", rate("alarms", "with_candidates"))


def tag_shares(rows: DataFrame, pool: str, consonants: tuple[str, ...], dgir: tuple[str, ...]) -> DataFrame:
    """rows (tag, KEEP left out) -> errors and the shares of consonants and of d, gi and r, by pool and over all (pool null)."""
    out = rows.where("tag <> 'KEEP'").rollup(pool).agg(F.count("*").alias("errors"), F.count_if(F.col("tag").isin(*consonants)).alias("c"), F.count_if(F.col("tag").isin(*dgir)).alias("d"))
    total = F.greatest("errors", F.lit(1))
    return out.select(pool, "errors", (F.col("c") / total).alias("consonant_share"), (F.col("d") / total).alias("dgir_share"))


def coverage(rows: DataFrame, covered: Column) -> DataFrame:
    """words, covered, share."""
    out = rows.agg(F.count("*").alias("words"), F.count_if(covered).alias("covered"))
    return out.withColumn("share", F.when(F.col("words") > 0, F.col("covered") / F.col("words")).otherwise(0.0))


def disagreement_by_distance(rows: DataFrame, most: int = 9) -> DataFrame:
    """rows (distance to the nearer edge, a, b: two results, null for none) -> distance (most stands for more), words, differ, share."""
    out = rows.groupBy(F.least("distance", F.lit(most)).alias("distance")).agg(F.count("*").alias("words"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
    return out.withColumn("share", F.col("differ") / F.col("words"))


def side_by_side(results: DataFrame, measure: str, config: str, value: str, configs: list[str]) -> DataFrame:
    """One row a measure, a column for each of configs, and each one's difference from the first."""
    wide = results.groupBy(measure).agg(*[F.max(F.when(F.col(config) == c, F.col(value))).alias(c) for c in configs])
    return wide.select(measure, *configs, *[(F.col(c) - F.col(configs[0])).alias(f"{c}_delta") for c in configs[1:]])


def start_matches(issues: DataFrame, spans: DataFrame) -> DataFrame:
    """Issues joined with the token that begins where they do; the others stay, with a null pos."""
    at = spans.select("doc_id", "start", "pos")
    return issues.join(at, ["doc_id", "start"], "left")


def only_in_first(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a has and b has not."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def node_offsets(nodes: DataFrame, lookups: DataFrame) -> DataFrame:
    """nodes (doc, node, start, end), lookups (doc, offset) -> offset with its node and the place in it; outside of all, null."""
    return within(lookups, "offset", nodes, "start", "end", "doc").select("doc", "offset", "node", (F.col("offset") - F.col("start")).alias("inside"))
