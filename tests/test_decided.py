"""Decisions on tags that all rows share, and policies counted by word, against the general operators."""

from __future__ import annotations

import random

import __spark_entry__
from pyspark.sql import functions as F

from vispark.operators import decisions, scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_of_fixed_tags(spark):
    dice = random.Random(3)
    for names in (("KEEP", "TONE_HOI", "CH_TR", "N_NG"), ("S_X", "KEEP"), ("CH_TR", "N_NG"), ("KEEP",)):
        logits = [[dice.choice([0.0, 1.0, 2.5, 8.0]) if i % 2 else dice.uniform(-9, 9) for _ in names] for i in range(400)]
        rows = spark.createDataFrame([(i, list(names), x) for i, x in enumerate(logits)], "id int, tags array<string>, logits array<double>")
        for kw in ({}, {"threshold": 0.4, "margin": 0.0, "consonant": None}, {"threshold": 0.5, "margin": 0.1, "consonant": 0.6, "thresholds": {"N_NG": 0.3}}):
            one, other = (decisions.gate(rows, **kw, **more).orderBy("id").collect() for more in ({}, {"names": names}))
            assert one == other


def test_gate_queries_take_no_steps_over_arrays(spark):
    for name in ("softmax_gate", "policy_sweep", "policy_report", "policy_pick", "confidence_outcomes", "diagnosis"):
        assert "lambda" not in plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_policies_counted_by_word(spark):
    dice = random.Random(4)
    rows = []
    for _ in range(3000):
        token = dice.choice(["an", "An", "bo", "Bo", "ca", "9"])
        keep = dice.choice([0.0, 0.1, 0.3, 1.0])
        best = dice.choice([0.5, 0.7, 0.8, 0.86, 0.91, 0.94, 0.96]) * (1 - keep)
        rows.append((token.lower(), token, dice.random() < 0.2, dice.choice(["S_X", None]), best, keep))
    df = spark.createDataFrame(rows, "word string, token string, first_word boolean, best string, best_p double, keep_p double")
    known = spark.createDataFrame([("an",), ("ca",), ("zu",)], "word string")
    want = scoring.policy_decisions(df.withColumn("known", F.col("word").isin("an", "ca")), 0.7).groupBy("word", "policy", "known")
    want = want.agg(F.count("*").alias("n"), F.count_if(F.col("decision") != "KEEP").alias("fires"))
    got = scoring.policy_counts(df, known, 0.7).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert plan(got).count("Aggregate") == 1
