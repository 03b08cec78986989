"""Model decisions: softmax over the allowed tags, thresholds, margins and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vispark.functions.alphabet import FINAL_TAGS, INITIAL_TAGS
from vispark.functions.text import apart

THRESHOLD, CONSONANT_THRESHOLD, MARGIN = 0.95, 0.90, 0.25


def softmax(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """rows with prob, the softmax of an array of logits, the largest subtracted first.

    The largest and the sum are generated as columns of their own, so that they are not computed anew for each logit.
    """
    rows = apart(rows, _top=F.array_max(logits))
    rows = apart(rows, _e=F.transform(logits, lambda x: F.exp(x - F.col("_top"))))
    rows = apart(rows, _sum=F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn("prob", F.transform("_e", lambda x: x / F.col("_sum"))).drop("_top", "_e", "_sum")


def gate(
    rows: DataFrame,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    consonant: float | None = CONSONANT_THRESHOLD,
    thresholds: dict[str, float] | None = None,
    names: tuple[str, ...] | None = None,
) -> DataFrame:
    """rows (tags, logits: parallel arrays) with prob, best, best_p, keep_p and decision.

    The strongest tag but KEEP, of equals the first, is chosen; only then its own threshold is looked up: in thresholds by tag, else
    consonant for tags of consonants, else threshold.  Below it, or less than the margin above KEEP, the decision is KEEP.
    names: the tags, where they are the same in all rows; then tags is not read, and no step goes over arrays.
    """
    out = _strongest(rows) if names is None else _strongest_of(rows, names)
    bar = F.lit(threshold)
    if consonant is not None:
        bar = F.when(F.col("best").isin(*INITIAL_TAGS, *FINAL_TAGS), consonant).otherwise(bar)
    for tag, own in (thresholds or {}).items():
        bar = F.when(F.col("best") == tag, own).otherwise(bar)
    fires = F.col("best").isNotNull() & (F.col("best_p") >= bar) & (F.col("best_p") - F.col("keep_p") >= margin)
    return out.withColumn("decision", F.when(fires, F.col("best")).otherwise("KEEP"))


def _strongest(rows: DataFrame) -> DataFrame:
    """rows (tags, logits) with prob, best, best_p and keep_p."""
    keep = F.array_position("tags", F.lit("KEEP")).cast("int")
    scored = apart(softmax(rows), _keep=keep)
    scored = apart(scored, _others=F.transform("prob", lambda p, i: F.when(i == F.col("_keep") - 1, -1.0).otherwise(p)))
    scored = apart(scored, _best=F.array_max("_others"))
    scored = apart(scored, _at=F.array_position("_others", F.col("_best")).cast("int"))
    found = F.col("_best") > 0
    out = scored.withColumn("keep_p", F.when(F.col("_keep") > 0, F.get("prob", F.col("_keep") - 1)).otherwise(0.0))
    out = out.withColumn("best", F.when(found, F.get("tags", F.col("_at") - 1))).withColumn("best_p", F.when(found, F.col("_best")).otherwise(0.0))
    return out.drop("_keep", "_others", "_best", "_at")


def _strongest_of(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """_strongest for tags that are the same in all rows, a column for each: Spark compiles it, as it does not a step over an array."""
    each, others = range(len(names)), [i for i, name in enumerate(names) if name != "KEEP"]
    most = lambda columns: F.greatest(*columns) if len(columns) > 1 else columns[0]
    out = apart(rows, **{f"_x{i}": F.get("logits", F.lit(i)) for i in each})
    out = out.withColumn("_top", most([F.col(f"_x{i}") for i in each])).withColumns({f"_e{i}": F.exp(F.col(f"_x{i}") - F.col("_top")) for i in each})
    out = out.withColumn("_sum", sum((F.col(f"_e{i}") for i in each), F.lit(0.0))).withColumns({f"_p{i}": F.col(f"_e{i}") / F.col("_sum") for i in each})
    out = out.withColumn("_best", most([F.col(f"_p{i}") for i in others]) if others else F.lit(-1.0))
    found, best = F.col("_best") > 0, F.lit(None).cast("string")
    for i in reversed(others):
        best = F.when(F.col(f"_p{i}") == F.col("_best"), names[i]).otherwise(best)
    out = out.withColumn("prob", F.array(*[F.col(f"_p{i}") for i in each])).withColumn("keep_p", F.col(f"_p{names.index('KEEP')}") if "KEEP" in names else F.lit(0.0))
    out = out.withColumn("best", F.when(found, best)).withColumn("best_p", F.when(found, F.col("_best")).otherwise(0.0))
    return out.drop("_top", "_sum", "_best", *[f"_{c}{i}" for c in "xep" for i in each])


def gate_argmax(rows: DataFrame) -> DataFrame:
    """rows with decision: the tag with the largest logit, KEEP included, of equals the first."""
    first = F.array_position("logits", F.array_max("logits")).cast("int")
    return rows.withColumn("decision", F.element_at("tags", first))


def sweep(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows (best, best_p, keep_p) for each of policies (policy, threshold, margin, drop_keep) with fires.

    drop_keep: KEEP is taken out and the rest scaled up to one.  One pass over rows, as the policies are a small fixed table.
    """
    each = rows.join(F.broadcast(policies))
    p = F.when(F.col("drop_keep"), F.col("best_p") / (1 - F.col("keep_p"))).otherwise(F.col("best_p"))
    lead = F.when(F.col("drop_keep"), p).otherwise(p - F.col("keep_p"))
    return each.withColumn("policy_p", p).withColumn("fires", (p >= F.col("threshold")) & (lead >= F.col("margin")))
