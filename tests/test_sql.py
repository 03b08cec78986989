"""The SQL names against the columns that they stand for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vispark import sql
from vispark.functions import syllable as sy
from vispark.functions.alphabet import TAGS, strip_tone, to_ascii
from vispark.functions.text import token_spans

WORDS = ["nguyễn", "Nguyên", "giết", "gì", "quả", "QUẢ", "nghĩ", "sẻ", "xanh", "Dành", "giành", "rành", "con", "công", "các", "cát", "hòa", "hoà", "b", "", "it's \\ a'", "khuya", "chia", "Trời", None]


@pytest.fixture(scope="module")
def words(spark):
    sql.register(spark)
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    df.createOrReplaceTempView("vi_words")
    return df


def test_functions(spark, words):
    w = F.col("w")
    want = words.select("w", strip_tone(w), to_ascii(w), sy.tone(w), sy.tone_place(w), sy.initial(w), sy.final(w)).collect()
    got = spark.sql("SELECT w, vi_strip_tone(w), vi_ascii(w), vi_tone(w), vi_tone_place(w), vi_initial(w), vi_final(w) FROM vi_words")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT vi_set_tone('nguyên', 4), vi_set_tone('a', 9)").first()[:] == ("nguyễn", None)


def test_tags(spark, words):
    want = {(r.w, t): r[t] for r in words.select("w", *[sy.apply_tag(t, F.col("w")).alias(t) for t in TAGS]).collect() for t in TAGS}
    tags = ", ".join(f"'{t}'" for t in TAGS)
    rows = spark.sql(f"SELECT w, tag, vi_apply_tag(w, tag) AS made FROM vi_words LATERAL VIEW explode(array({tags})) AS tag")
    assert {(r.w, r.tag): r.made for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan.upper() and "Python" not in plan


def test_tokens(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, "Chia sẻ, 3.5 😀 ét"), (2, None), (3, ""), (4, "a b " * 500), (5, "!!!")], "doc_id long, text string")
    docs.createOrReplaceTempView("vi_texts")
    got = spark.sql("SELECT doc_id, t.* FROM vi_texts, LATERAL vi_tokens(text) t")
    want = token_spans(docs).select("doc_id", "pos", "tok", "start", "end")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
