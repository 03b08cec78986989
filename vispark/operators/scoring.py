"""Decisions on out-of-lexicon words by policy, and what a policy must reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Policy, kind (plain: the common rule; drop: KEEP is out and the rest scaled up; names: as drop, but capitalised words
# that do not begin a sentence keep the common rule; bar: a bar of its own and no margin), its bar.
POLICIES = (
    ("P0", "plain", None), ("P1", "drop", None), ("P2", "names", None), ("T0.80", "bar", 0.80), ("T0.85", "bar", 0.85), ("T0.90", "bar", 0.90), ("T0.93", "bar", 0.93),
)


def _fires(kind: str, bar: float | None, known: Column, threshold: float, margin: float) -> Column:
    """Whether rows (token, first_word, best, best_p, keep_p) are decided by a policy of this kind; known ones by the common rule."""
    head = F.substring("token", 1, 1)
    name = ~F.col("first_word") & (head == F.upper(head)) & (head != F.lower(head))
    plain = (F.col("best_p") >= threshold) & (F.col("best_p") - F.col("keep_p") >= margin)
    rest = 1 - F.col("keep_p")
    scaled = F.when(rest > 1e-9, F.col("best_p") / rest).otherwise(1.0) >= threshold
    own = {"plain": plain, "drop": scaled, "names": F.when(name, plain).otherwise(scaled), "bar": F.col("best_p") >= F.lit(bar).cast("double")}[kind]
    return F.col("best").isNotNull() & F.when(known, plain).otherwise(own)


def policy_decisions(rows: DataFrame, threshold: float = 0.95, margin: float = 0.25, policies=POLICIES) -> DataFrame:
    """rows (token, first_word, known, best, best_p, keep_p) for each policy, with policy and decision (best or KEEP).

    Only words that the lexicon lacks are decided by the policy; known ones by the common rule.  One pass: the policies are
    an array that each row is exploded with.
    """
    decision = lambda k, b: F.when(_fires(k, b, F.col("known"), threshold, margin), F.col("best")).otherwise("KEEP")
    each = F.array(*[F.struct(F.lit(p).alias("policy"), decision(k, b).alias("decision")) for p, k, b in policies])
    return rows.select("*", F.inline(each))


def policy_counts(rows: DataFrame, known: DataFrame, threshold: float = 0.95, margin: float = 0.25, policies=POLICIES) -> DataFrame:
    """rows (word, token, first_word, best, best_p, keep_p); known: word, each once -> word, policy, known, n, fires (decisions but KEEP).

    As policy_decisions counted by word.  Each policy's decisions are counted for the case that the word is known and that it is not, and
    the lexicon is joined to the counts: neither rows nor rows times policies are exchanged.
    """
    count = lambda k, b, known: F.count_if(_fires(k, b, F.lit(known), threshold, margin))
    unknown = {f"_fires{i}": count(k, b, False) for i, (_, k, b) in enumerate(policies)}
    counts = rows.groupBy("word").agg(F.count("*").alias("n"), count("plain", None, True).alias("_plain"), *[c.alias(name) for name, c in unknown.items()])
    counts = counts.join(known.select(F.col("word").alias("_word"), F.lit(True).alias("_known")), F.col("word") == F.col("_word"), "left")
    each = [F.struct(F.lit(p).alias("policy"), F.coalesce("_known", F.lit(False)).alias("known"), "n", F.when(F.col("_known"), F.col("_plain")).otherwise(F.col(f"_fires{i}")).alias("fires")) for i, (p, *_) in enumerate(policies)]
    return counts.select("word", F.inline(F.array(*each)))


# What a policy must reach: measure, comparison, bar.
BARS = (
    ("precision", ">=", 0.95), ("bao_oan_a", "<=", 0.015), ("bao_oan_b", "<=", 0.015), ("phu_am", ">=", 0.463), ("d_gi_r", ">=", 0.325), ("sua_sai_dgir", "<=", 0.08),
)


def with_bars(measures: DataFrame, bars=BARS) -> DataFrame:
    """One row a policy with a column for each measure -> the same with failed (names of the bars not reached) and passes."""
    broken = [F.when(~(F.col(m) >= b if op == ">=" else F.col(m) <= b), m) for m, op, b in bars]
    out = measures.withColumn("failed", F.concat_ws(",", *broken))
    return out.withColumn("passes", F.col("failed") == "")


def pick_policy(judged: DataFrame, *false_alarms: str) -> DataFrame:
    """Of the policies that pass, the one with the smallest sum of false-alarm rates, of equals the first by name."""
    total = sum((F.col(c) for c in false_alarms), F.lit(0.0))
    return judged.where("passes").orderBy(total, "policy").limit(1)
