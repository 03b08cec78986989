"""Exact dedup, mixing and preference formatting."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vispark.llm.chat_format import format_preferences
from vispark.llm.exact_dedup import chunks, drop_exact_duplicates, exact_duplicates
from vispark.llm.mixing import mix, mixed_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7) for i, t, s in rows], DOCS)


LONG = " ".join(f"word{i} ran and ran" for i in range(20_000))
ROWS = [
    (5, "a  b", "s"), (3, "a\n b", "s"), (9, "a b", None), (4, "ab", "s"), (None, "ab", "s"), (7, None, "t"), (8, "", "t"),
    (1, LONG, "s"), (2, LONG.replace(" ", "\t"), "s"), (6, LONG + " end", "s"), (4, "ab", "s"),
]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    docs = _docs(spark, ROWS)
    got = exact_duplicates(docs, lambda c: F.substring(c, 1, 1)) if weak else exact_duplicates(docs)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    want = {5: (3, 3), 3: (3, 3), 9: (3, 3), 4: (4, 3), None: (4, 3), 7: (7, 2), 8: (7, 2), 1: (1, 2), 2: (1, 2), 6: (6, 1)}
    assert all((r.keep_id, r.group_size) == want[r.doc_id] for r in rows)
    assert sorted(r.doc_id for r in rows if r.kept) == [1, 3, 4, 6, 7]  # of the repeated row 4, one is kept


def test_dropping_keeps_columns_and_empty_tables(spark):
    docs = _docs(spark, ROWS)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7]
    assert exact_duplicates(docs.limit(0)).count() == 0


CLASHES = ("row", "_k0", "_k1", "_k2", "_kept", "_n", "_id", "_hash", "_sha", "_times", "_epoch", "_more", "toxic", "kept", "name", "key", "first", "n", "skey", "size", "part", "target", "a.b")


def test_dropping_and_mixing_take_clashing_columns(spark):
    docs = _docs(spark, ROWS).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7]
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in mix(docs).collect())
    empty = docs.limit(0)
    assert drop_exact_duplicates(empty).count() == mixed_documents(empty).count() == 0


def test_mixing_takes_repeated_rows_as_often_as_counted(spark):
    rows = [(1, "one two three", "a")] * 40 + [(None, "x y", "a")] * 7 + [(1, "one two three", "b"), (2, "w " * 90, "b"), (3, "v " * 400, "c")]
    docs = _docs(spark, rows)
    want = {}
    for r in mix(docs).collect():
        key = (r.doc_id, r.skey)
        want[key] = want.get(key, 0) + r.times
    got = {}
    for r in mixed_documents(docs).collect():
        key = (r.doc_id, "0" + r.source)
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_chunks_make_up_the_text(spark):
    df = spark.createDataFrame([(LONG,), ("",), ("x" * 10_000,)], "t string").select("t", F.array_join(chunks(F.col("t")), "").alias("u"))
    assert all(r.t == r.u for r in df.collect())


def test_mix_against_plain_python(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 50 + ["b"] * 9 + ["c"] * 3 + [None] * 5)] + [(900, None, "a"), (901, "", "d")]
    out = mix(_docs(spark, rows)).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]] if total else []
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= set(over)
        rest = 1.5 * sum(sizes.values()) - sum(target[s] for s in names if s not in free)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 7 for s in names)
    again = {(r.doc_id, r.taken) for r in mix(_docs(spark, rows).repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    assert mixed_documents(_docs(spark, rows)).count() == sum(r.times for r in out)
    assert mix(_docs(spark, [])).count() == 0


TURNS = "pair_id long, turn long, role string, text string, pos int"


def test_preferences(spark):
    chosen = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (2, 0, "user", None, 0), (3, 0, "user", "same", 0), (None, 0, "user", "n", 0)]
    rejected = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "no", 0), (1, 2, "user", "?", 0), (3, 0, "user", "same", 0), (4, 0, "assistant", "x", 0)]
    out = {r.pair_id: r for r in format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()}
    r = out[1]
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.prompt_turns == 1
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "yes<|im_end|>" and r.rejected.endswith("<|im_start|>user\n?<|im_end|>\n") and "," not in r.rejected_mask
    assert (out[3].chosen, out[3].rejected, out[3].prompt_turns) == ("", "", 1)
    assert out[4].chosen == "" and out[4].prompt == "" and out[2].rejected == "" and set(out) == {1, 2, 3, 4, None}
    empty = spark.createDataFrame([], TURNS)
    assert format_preferences(empty, empty).count() == 0
