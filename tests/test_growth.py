"""Plans that must not move or hold more than they need: what queries over larger tables stood and fell with."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from vispark.functions.text import hash_below, token_spans, unit_hash
from vispark.operators import corpus, encoding, issues, reports
from vispark.plans import catalogue
from vispark.plans.inputs import pairs, predicted

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_pairs_are_made_within_the_row(spark, tmp_path):
    shown = plan(predicted(spark, DATA))
    assert "Exchange" not in shown and "Window" not in shown
    rows = [(1, "Một hai, BA bốn"), (2, None), (3, ""), (4, "một"), (5, "x y")]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pairs(spark, str(tmp_path)).select("doc_id", "pos", "want").collect()))
    assert got == [(1, 1, "hai"), (1, 2, "ba"), (1, 3, "bốn"), (5, 1, "y")]


def test_a_hash_is_computed_once_a_row(spark):
    # Seed 3 of the pairs stands once in a plan, however often their words are compared.
    assert plan(predicted(spark, DATA).where("got <> wrong")).count("concat_ws(|, 3,") == 1


def test_two_predictions_of_a_word_need_no_join(spark):
    assert "Join" not in plan(catalogue.QUERIES["disagreement_by_distance"](spark, DATA))


@pytest.mark.parametrize("name", ["scope_report", "scope_by_tag"])
def test_errors_meet_tags_in_one_pass(spark, name):
    assert plan(catalogue.QUERIES[name](spark, DATA)).count("FileScan parquet") == 3  # errors, their words, the lexicon


def test_cuts_hold_no_group_of_values(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 'a' WHEN id < 3003 THEN NULL ELSE 'b' END AS k", "CASE WHEN id < 3003 THEN (id * 7919 % 3000) / 3000 END AS v")
    found = reports.above_cuts(rows, "v", "k")
    assert "percentile" not in plan(found)
    got = {r["k"]: tuple(r)[1:] for r in found.collect()}
    want = {r["k"]: tuple(r)[1:] for r in rows.groupBy("k").agg(F.count("v"), *[F.percentile("v", F.lit(p)) for p in (0.5, 0.75, 0.9)], *[F.count_if(F.col("v") >= c) for c in (0.8, 0.7, 0.6, 0.5)]).collect()}
    assert got.keys() == want.keys() and got["b"] == (0, None, None, None, 0, 0, 0, 0)
    for k in ("a", None):
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_sentences_of_tokens_are_numbered_within_the_row(spark):
    docs = spark.createDataFrame([(1, "Một hai. Ba bốn! năm\nSáu? Bảy"), (2, ". Một hai"), (3, None)], "doc_id long, text string")
    rows = corpus.sentence_tokens(docs)
    assert "Exchange" not in plan(rows) and dict(rows.dtypes)["sent"] == "bigint"
    got = sorted(map(tuple, rows.select("doc_id", "pos", "sent").collect()))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (1, 6, 2), (2, 0, 1), (2, 1, 1)]


def test_unknown_words_are_not_broken_first(spark):
    words = spark.createDataFrame([("sẽ",), ("Sẽ",), ("trở",), ("zzz",)], "word string")
    known = spark.createDataFrame([("sẽ",)], "word string")
    found = corpus.corruptions(words, known)
    shown = plan(found)  # both sides of the last join look words up before they are taken apart
    assert shown.count("LeftSemi") == 2 and shown.rindex("LeftSemi") > shown.rindex("Generate inline")
    assert {r.word for r in found.collect()} == {"sẽ", "Sẽ"}


def test_one_option_of_a_class_travels_for_a_token(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "a")], "doc_id long, sent long, pos int, tok string")
    options = spark.createDataFrame([("a", f"b{i}", "S_X") for i in range(40)], "word string, broken string, fix string")
    out = corpus.corrupt(tokens, options, rate=1.1)
    assert "array_min" in plan(out).rsplit("Exchange hashpartitioning(doc_id", 1)[-1]  # below the exchange by sentence
    assert out.count() == 1 and out.first()["tag"] == "S_X"


def test_cues_are_found_without_windows_over_tokens(spark):
    shown = plan(catalogue.QUERIES["context_issues"](spark, DATA))
    assert "lag(" not in shown and "lead(" not in shown and "BroadcastHashJoin" in shown  # the pairs are a small fixed table
    docs = spark.createDataFrame([(1, "a B c d"), (2, "e"), (3, None)], "doc_id long, text string")
    names = ["near_0", "near_1", "near_2", "near_4", "near_5", "near_6"]
    got = sorted(tuple(r) for r in token_spans(docs, near=3).select("doc_id", "pos", *names).collect())
    assert got == [
        (1, 0, None, None, None, "b", "c", "d"), (1, 1, None, None, "a", "c", "d", None), (1, 2, None, "a", "b", "d", None, None),
        (1, 3, "a", "b", "c", None, None, None), (2, 0, *[None] * 6),
    ]


def test_spans_that_are_merged_are_made_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = plan(catalogue.QUERIES["merge_rule_first"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert shown.count("FileScan parquet") == 1 and shown.count("ReusedExchange") == 1 and "Join" not in shown


def test_rules_first_without_pairs(spark):
    places = [(1, s, e) for s, e in ((0, 0), (0, 5), (5, 5), (5, 9), (4090, 4096), (4095, 9000), (4096, 4096), (8192, 8200), (9000, 9001), (None, 3), (3, None))] + [(None, 0, 5), (2, 5, 9)]
    for r in range(0, len(places), 3):
        rows = [(*p, k % 3 == r // 3 % 3, k) for k, p in enumerate(places)] + [(*places[r], False, 99)] * 2  # and two rows alike
        known = lambda *v: None not in v
        over = lambda m, r: known(*m[:3], *r[:3]) and m[0] == r[0] and m[1] < r[2] and r[1] < m[2]
        want = [m for m in rows if m[3] or not any(over(m, x) for x in rows if x[3])]
        df = spark.createDataFrame(rows, 'doc_id long, start int, `end` int, rule boolean, k int')
        got = issues.rule_first(df, F.col("rule"))
        assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1 / 3, 0.999])
def test_a_share_is_told_by_digits(spark, share):
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id")))
    assert rows.where((unit_hash(4, F.col("id"), F.col("k")) < share) != hash_below(share, 4, F.col("id"), F.col("k"))).count() == 0


def test_only_words_within_reach_are_looked_up(spark):
    sentences = [("a", [f"w{i}" for i in range(5000)]), ("b", ["w0", None, "long", "w1"]), ("c", []), ("d", None), ("e", ["w1"] * 6), ("f", ["long"] * 9)]
    table = spark.createDataFrame([("w0", [7]), ("w1", [8]), ("long", [1, 2, 3, 4]), ("w2", [])], "word string, ids array<int>")
    rows = spark.createDataFrame([(*r, 1) for r in sentences], "key string, words array<string>, more int")
    out = encoding.encode_words(rows, table, 6)
    got = {r.key: (r.ids, r.word_ids, r.first) for r in out.collect()}
    assert out.columns == ["key", "words", "more", "ids", "word_ids", "first"]
    assert got["a"] == ([0, 7, 8, 3, 3, 2], [-1, 0, 1, 2, 3, -1], [1, 2, 3, 4] + [-1] * 4996)
    assert got["b"] == ([0, 7, 3, 2], [-1, 0, 1, -1], [1, 2, -1, -1]) and got["c"] == ([0, 2], [-1, -1], []) and got["d"] == ([0, 2], [-1, -1], None)
    assert got["e"] == ([0, 8, 8, 8, 8, 2], [-1, 0, 1, 2, 3, -1], [1, 2, 3, 4, -1, -1]) and got["f"] == ([0, 1, 2, 3, 4, 2], [-1, 0, 0, 0, 0, -1], [1] + [-1] * 8)
    assert encoding.encode_words(rows, table, 1).where("size(ids) = 2 AND (words IS NULL OR forall(first, x -> x = -1))").count() == 6
    shown = plan(catalogue.QUERIES["encoded_sentences"](spark, DATA))
    assert shown.count("explode(slice(") == shown.count("explode(") == 2  # the words that are taken apart, and those that are looked up


def test_corrupted_texts_travel_whole(spark):
    shown = plan(catalogue.QUERIES["corrupt_sentences"](spark, DATA)) + plan(catalogue.QUERIES["restored_tokens"](spark, DATA))
    assert "hashpartitioning(doc_id" not in shown and "hashpartitioning(tok" not in shown and "collect_list" not in shown


def test_corrupted_texts_are_as_corrupted_tokens(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CHUNK_CHARS", 100)  # many chunks
    texts = ["Nghĩ lại nỗ lực sẽ trở nên. Chia sẻ nữa thì tốt! 3.5 sữa\u000b" * 9, "sẽ", None, "", "12 ...", "không có. Gì trong"]
    docs = spark.createDataFrame([(k, t * 3 if t else t) for k, t in enumerate(texts * 20)] + [(None, texts[0])], "doc_id long, text string")
    toks = corpus.sentence_tokens(docs)
    words = toks.select(F.col("tok").alias("word")).distinct()
    options = corpus.corruptions(words, words.where("word <> 'trong'").select(F.lower("word").alias("word")).distinct()).select("word", "broken", "fix")
    for rate, most in ((0.3, 4), (1.0, 40)):
        want = sorted(map(str, corpus.corrupt(toks, options, rate, most).collect()))
        out = corpus.corrupt_texts(docs, options, rate, most)
        got = out.select("doc_id", F.posexplode(F.arrays_zip(F.col("toks").alias("tok"), F.col("tags").alias("tag"))).alias("pos", "t")).select("doc_id", "pos", "t.tok", "t.tag")
        assert sorted(map(str, got.collect())) == want and sum("tag='KEEP'" not in r for r in want) > 100


def test_draws_over_arrays_are_the_same(spark):
    import numpy as np

    from vispark.operators import draws

    rows = spark.range(500).selectExpr("id - 250 AS a", "cast(id * 7919 - 99999 AS int) AS b").collect()
    a, b = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    df = spark.createDataFrame(rows, "a long, b int")
    state = np.array([r[0] for r in df.select(F.xxhash64(F.lit(5), "a")).collect()], np.int64).view(np.uint64)
    for name in ("", "D_R", "hoi_nga", "other_tone", "missing-tone-or-no-tone"):
        want = [r[0] for r in df.select(corpus.draw(5, F.col("a"), F.col("a"), F.col("b"), F.lit(name))).collect()]
        assert draws.unit(draws.with_name(draws.with_int(draws.with_long(state, a), b), name)).tolist() == want
