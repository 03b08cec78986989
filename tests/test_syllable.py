"""Syllable functions against literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from vispark.functions import alphabet as al
from vispark.functions import syllable as sy

TONES = (
    ("buôn", al.GRAVE, "buồn"), ("tiêng", al.ACUTE, "tiếng"), ("nguyên", al.TILDE, "nguyễn"), ("quyên", al.HOOK, "quyển"),
    ("hoan", al.DOT, "hoạn"), ("mua", al.GRAVE, "mùa"), ("cuôi", al.ACUTE, "cuối"), ("ngươi", al.GRAVE, "người"), ("giay", al.GRAVE, "giày"),
    ("khuyu", al.HOOK, "khuỷu"), ("cua", al.HOOK, "của"), ("qua", al.GRAVE, "quà"), ("giưa", al.TILDE, "giữa"), ("quôc", al.ACUTE, "quốc"),
    ("nổ", al.TILDE, "nỗ"), ("trãi", al.HOOK, "trải"), ("hổ", al.TILDE, "hỗ"), ("nữa", al.HOOK, "nửa"), ("NỔ", al.TILDE, "NỖ"), ("hmm", al.ACUTE, "hmm"),
)


def test_set_tone(spark):
    rows = spark.createDataFrame([(s, w, t) for s, t, w in TONES], "s string, w string, t int")
    chosen = F.element_at(F.array(*[sy.set_tone(F.col("s"), t) for t in range(6)]), F.col("t") + 1)
    assert [r.w for r in rows.collect()] == [r[0] for r in rows.select(chosen).collect()]


def test_parts(spark):
    rows = spark.createDataFrame([("nghiêng",), ("giết",), ("quan",), ("trong",), ("ăn",), ("gì",), ("",)], "s string")
    got = rows.select(sy.initial(F.col("s")), sy.rime(F.col("s")), sy.final(F.col("s"))).toDF("i", "r", "f").collect()
    want = [("ngh", "iêng", "ng"), ("gi", "ết", "t"), ("qu", "an", "n"), ("tr", "ong", "ng"), ("", "ăn", "n"), ("g", "ì", ""), ("", "", "")]
    assert [tuple(r) for r in got] == want


def test_set_initial_and_final(spark):
    cases = (("chân", "tr", "trân"), ("sử", "x", "xử"), ("dành", "gi", "giành"), ("lăm", "n", "năm"), ("cần", "k", "cần"), ("ngan", "ngh", "ngan"), ("nghe", "ng", "nghe"), ("Dành", "gi", "GIành"))
    for s, new, want in cases:
        assert spark.range(1).select(sy.set_initial(F.lit(s), new)).first()[0] == want
    assert spark.range(1).select(sy.set_final(F.lit("HOÀN"), "ng")).first()[0] == "HOÀng"


def test_candidates_and_tone(spark):
    got: dict[str, list] = {}
    for r in sy.candidate_rows(spark.createDataFrame([("dành",), ("hmm",)], "word string")).collect():
        got.setdefault(r.word, []).append((r.tag, r.result))
    assert got["hmm"] == [("KEEP", "hmm")]
    assert ("D_GI", "giành") in got["dành"] and ("D_R", "rành") in got["dành"] and ("TONE_HUYEN", "dành") not in got["dành"]
    one = spark.range(1).select(sy.tone(F.lit("nghỉ")).alias("a"), sy.tone(F.lit("ba")).alias("b"), sy.tone(F.lit("hm")).alias("c")).first()
    assert tuple(one) == (al.HOOK, 0, None)
    assert len(al.TAGS) == 23
