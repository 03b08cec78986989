"""What is sifted out before a join, and what is computed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from vispark.operators import corpus, windows


def test_sifted_keeps_all_members(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("word"), "id")
    members = spark.range(0, 20_000, 40).select(F.concat(F.lit("w"), "id").alias("name"))
    got = {r.id for r in corpus.sifted(rows, F.col("word"), members, "name").collect()}
    assert got >= set(range(0, 20_000, 40)) and len(got) < 520
    assert corpus.sifted(rows, F.col("word"), members.limit(0), "name").columns == rows.columns
    assert corpus.sifted(rows, F.col("word"), members.limit(0), "name").count() == 0


def test_offsets_are_kept(spark):
    rows = windows.with_offsets(spark.createDataFrame([("a", [40] * 7), ("b", [1]), ("c", [])], "key string, counts array<int>"))
    plain = windows.centred(windows.run_plan(rows.drop("_offs")))
    plans = windows.run_plan(rows)
    assert "_offs" in plans.columns and windows.owned(plans).columns[-1] == "windows"
    assert sorted(windows.centred(plans).collect()) == sorted(plain.collect())


def test_sentences_without_a_choice_are_not_scored(spark):
    from tests.test_model import TOKENIZER
    from vispark.operators import model

    rows = [("a", ["sẽ", "chia"]), ("b", ["xyz"] * 3), ("c", ["xyz"] * 200 + ["sẽ"]), ("d", []), ("e", ["xyz"] * 200)]
    df = spark.createDataFrame(rows, "key string, words array<string>")
    bits = model.marked(spark.createDataFrame([("sẽ",)], "word string"), "word")
    every = {(r.key, *o) for r in model.encoded_windows(df, TOKENIZER).collect() for o in r.own}
    some = {(r.key, *o) for r in model.encoded_windows(df, TOKENIZER, bits=bits).collect() for o in r.own}
    assert some == {o for o in every if o[1] == "sẽ"} and {o[0] for o in some} == {"a", "c"} and {o[0] for o in every} == {"a", "b", "c", "e"}
