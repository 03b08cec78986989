"""Rule checks on single sentences: what is found, and what must stay silent."""

from __future__ import annotations

import pytest

from vispark.operators import issues, rules
from vispark.operators.rule_tables import PAIRS

FOUND = (
    ("Cả nhóm nổ lực, chia sẽ cùng nhau.", [(8, 14, "nỗ lực"), (16, 23, "chia sẻ")]),
    ("NỔ LỰC", [(0, 6, "NỖ LỰC")]),
    ("nổ,\nlực", [(0, 7, "nỗ lực")]),
    ("sữa chửa", [(0, 8, "sửa chữa")]),
    ("😀 Chia sẽ", [(2, 9, "Chia sẻ")]),
    ("một tiếng nữa thôi", []),
    ("Hôm nay trời đẹp.", []),
    ("", []),
    (None, []),
)


def test_check_text(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "doc_id long, text string")
    got: dict[int, list] = {}
    for r in rules.check_text(docs).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.suggestion))
    assert got == {i: w for i, (_, w) in enumerate(FOUND) if w}


def test_ignored_words_go_after_overlaps(spark):
    docs = spark.createDataFrame([(0, "nổ lực")], "doc_id long, text string")
    ignored = spark.createDataFrame([("nổ lực",)], "word string")
    assert rules.check_text(docs, ignored=ignored).count() == 0


@pytest.mark.parametrize("empty", [True, False])
def test_dedupe_issues(spark, empty):
    rows = [] if empty else [(1, 0, 3, 0.9, "a", "x"), (1, 0, 6, 0.8, "a", "y"), (1, 5, 9, 0.99, "a", "z"), (1, 6, 8, 0.9, "a", "w")]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, confidence double, source string, suggestion string")
    assert sorted(r.suggestion for r in issues.dedupe_issues(df).collect()) == ([] if empty else ["w", "y"])


def test_all_twenty_pairs_are_built_in(spark):
    assert len(PAIRS) == len(set(PAIRS)) == 20 and sum(form[2] for _, *both in PAIRS for form in both) == 8 and rules.pair_table(spark).count() == 40
    cases = {1: ("thịt mở lợn", "mỡ"), 2: ("đội ngủ đông", "ngũ"), 3: ("hủ gạo", "hũ"), 4: ("cùng dành ngôi", "giành"), 5: ("đọc chuyện tranh", "truyện"), 6: ("giở ẹ", "dở"), 7: ("củng cố", None)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r.suggestion for r in rules.check_text(docs).where("confidence < 0.99").collect()}
    assert got == {i: w for i, (_, w) in cases.items() if w}


def test_in_row_and_joined_checks_agree(spark):
    from vispark.plans.rule_texts import rule_texts

    docs = spark.createDataFrame(list(enumerate(rule_texts())), "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "end", "original", "suggestion", "why", "tag", "confidence", "source").collect())
    row, joined = rows(rules.check_text(docs)), rows(rules.check_text(docs, phrases=rules.phrase_table(spark), pairs=rules.pair_table(spark)))
    assert row == joined and len(row) > 900
    assert {r[7] for r in row} == {0.99, 0.93, 0.88, 0.90, 0.85}
    assert len({r[4].lower() for r in row}) > 150


def test_phrases_have_their_explanations(spark):
    from vispark.operators.rule_tables import PHRASES

    assert len(PHRASES) == len({p[0] for p in PHRASES}) == 137 and all(len(p) == 4 and p[3] for p in PHRASES)
    docs = spark.createDataFrame([(1, "Nổ lực")], "doc_id long, text string")
    assert rules.check_text(docs).first().why == '"nỗ" là gắng sức; "nổ" là phát nổ'
