"""Decisions, metrics, windows and streaming operators on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from vispark.operators import corpus, decisions, metrics
from vispark.streaming import events as ev


def test_gate_uses_the_winners_threshold(spark):
    rows = spark.createDataFrame([(["KEEP", "D_GI"], [0.0, 2.45]), (["KEEP", "TONE_NGA"], [0.0, 2.45]), (["KEEP"], [1.0])], "tags array<string>, logits array<double>")
    assert [r.decision for r in decisions.gate(rows).collect()] == ["D_GI", "KEEP", "KEEP"]
    assert [r.decision for r in decisions.gate_argmax(rows).collect()] == ["D_GI", "TONE_NGA", "KEEP"]


def test_confusion_counts_a_wrong_fix_twice(spark):
    rows = spark.createDataFrame([("a", "b", "b"), ("a", "b", "c"), ("a", "b", "a"), ("a", "a", "b"), ("a", "a", "a")], "wrong string, want string, got string")
    got = metrics.confusion(rows).first()
    assert (got.tp, got.fp, got.fn) == (1, 2, 2)


def test_latest_only_stream(spark, tmp_path):
    schema = "key string, seq long"
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = ev.latest_only(stream, "key", "seq").writeStream.format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [("a", 1), ("a", 3), ("b", 2)]


def test_weeks_and_changes(spark):
    weeks = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00'), (timestamp'2023-01-01 00:00:00') t(ts)").select(ev.week_key(F.col("ts"))).collect()
    assert [r[0] for r in weeks] == ["2024-W01", "2022-W52"]
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "k int, t int, v string")
    assert [r.t for r in ev.changes(rows, "k", ["t"], "v").orderBy("t").collect()] == [0, 2, 3]


def test_corrupt_draws_by_sentence_as_plain_python_does(spark):
    import hashlib
    import math

    text = "Nghĩ lại nỗ lực sẽ trở nên dễ hơn. " * 12 + "Chia sẻ nữa thì tốt! 3.5 sữa"
    docs = spark.createDataFrame([(1, text), (2, text.lower()), (3, None), (4, "SẼ")], "doc_id long, text string")
    tokens = corpus.sentence_tokens(docs)
    words = tokens.select(F.col("tok").alias("word")).distinct()
    known = words.select(F.lower("word").alias("word")).distinct()
    options = corpus.corruptions(words, known).select("word", "broken", "fix")
    factors = spark.createDataFrame([("sẽ", 20.0), ("trở", 0.2)], "word string, factor double")
    got = {(r.doc_id, r.pos): (r.tok, r.tag) for r in corpus.corrupt(tokens, options, rate=0.6, factors=factors).collect()}

    table: dict[str, list] = {}
    for r in options.select("*", corpus.error_class(F.col("word"), F.col("broken"), F.col("fix")).alias("class")).collect():
        table.setdefault(r.word, []).append((r.broken, r.fix, r["class"]))
    rows = sorted(tuple(r) for r in tokens.collect())
    sents: dict[tuple, list] = {}
    for d, s, p, t in rows:
        sents.setdefault((d, s), []).append((p, t))
    assert {d: len({s for e, s in sents if e == d}) for d, _ in sents} == {1: 13, 2: 1, 4: 1}
    cases = spark.createDataFrame([(d, p, i) for d, _, p, t in rows for i in range(len(table.get(t, [])))], "doc_id long, pos int, i int")
    u_option = {tuple(r)[:3]: r.u for r in cases.withColumn("u", corpus.draw(12, "doc_id", "pos", "i")).collect()}
    rounds = spark.createDataFrame([(d, s, k, c) for d, s in sents for k in range(1, 5) for c in corpus.CLASS_WEIGHTS], "doc_id long, sent long, k int, class string")
    u_class = {tuple(r)[:4]: r.u for r in rounds.withColumn("u", corpus.draw(13, "doc_id", "sent", "k", "class")).collect()}
    unit = lambda d, p: int(hashlib.sha256(f"11|{d}|{p}".encode()).hexdigest()[:8], 16) / 2**32
    want, factor = {(d, p): (t, "KEEP") for d, _, p, t in rows}, {"sẽ": 20.0, "trở": 0.2}
    for (d, s), toks in sents.items():
        pool = [(p, *o, -math.log(u_option[d, p, i]) / factor.get(t.lower(), 1.0)) for p, t in toks for i, o in enumerate(sorted(table.get(t, [])))]
        n = min(4, sum(t in table and unit(d, p) < 0.6 for p, t in toks))
        for k in range(1, n + 1):
            free = [o for o in pool if want[d, o[0]][1] == "KEEP"]
            if free:
                c = min({o[3] for o in free}, key=lambda c: -math.log(u_class[d, s, k, c]) / corpus.CLASS_WEIGHTS[c])
                p, broken, fix, *_ = min((o for o in free if o[3] == c), key=lambda o: o[4])
                want[d, p] = (broken, fix)
    assert got == want
    changed = [(d, p, t) for d, _, p, t in rows if got[d, p][1] != "KEEP"]
    assert sum(d == 1 for d, _, _ in changed) > 4 >= sum(d == 2 for d, _, _ in changed)
    assert any(t != t.lower() for _, _, t in changed)
    per_word: dict[str, set] = {}
    for d, p, t in changed:
        per_word.setdefault(t, set()).add(got[d, p][0])
    assert max(len(b) for b in per_word.values()) > 1
