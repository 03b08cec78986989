"""SQL names for the library's functions: register(spark), then they can be called from any SQL text of the session.

vi_strip_tone(s), vi_ascii(s), vi_tone(s), vi_tone_place(s), vi_set_tone(s, tone), vi_initial(s), vi_final(s) and vi_apply_tag(s, tag) are
temporary functions with SQL bodies, which the optimizer puts into the plan: nothing is called row by row.  vi_tokens(text) is a table function
in Arrow batches, for LATERAL: pos, tok, start, end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vispark.functions import syllable as sy
from vispark.functions.alphabet import FINAL_TAGS, FLATS, INITIAL_TAGS, TONE_TAGS, strip_tone, to_ascii, vowels
from vispark.functions.text import TOKEN


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _body(spark: SparkSession, column: Column, parameters: str) -> str:
    """The SQL text of a column over the parameters."""
    plan = spark.createDataFrame([], parameters).select(column.alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


@F.udtf(returnType="pos int, tok string, start int, end int", useArrow=True)
class _Tokens:
    """The tokens of a text with their places in code points; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, int, int]]:
        import regex

        for i, m in enumerate(regex.finditer(TOKEN, text or "")):
            yield i, m.group(), m.start(), m.end()


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; what they take and give is as in vispark.functions, null for null."""
    s, old = F.col("s"), F.col("old")

    def make(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    one = "s string"
    for name, returns, column in (
        ("vi_strip_tone", "STRING", strip_tone(s)),
        ("vi_ascii", "STRING", to_ascii(s)),
        ("vi_tone", "INT", sy.tone(s)),
        ("vi_tone_place", "INT", sy.tone_place(s)),
        ("vi_initial", "STRING", sy.initial(s)),
        ("vi_final", "STRING", sy.final(s)),
    ):
        make(name, one, returns, _body(spark, column, one))
    marks = "array(" + ", ".join(_text(vowels(k)) for k in range(len(TONE_TAGS))) + ")"
    letter = f"translate(vi_strip_tone(substr(s, place, 1)), {_text(FLATS)}, element_at({marks}, tone + 1))"
    make("vi_put_tone", "s STRING, tone INT, place INT", "STRING", f"CASE WHEN place = 0 THEN s ELSE concat(substr(s, 1, place - 1), {letter}, substr(s, place + 1)) END")
    make("vi_set_tone", "s STRING, tone INT", "STRING", "CASE WHEN tone BETWEEN 0 AND 5 THEN vi_put_tone(s, tone, vi_tone_place(s)) END")
    news = sorted({new for _, new in INITIAL_TAGS.values()})
    cases = " ".join(f"WHEN {_text(new)} THEN {_body(spark, sy.set_initial(s, new, old), 's string, old string')}" for new in news)
    make("vi_put_initial", "s STRING, new STRING, old STRING", "STRING", f"CASE new {cases} END")
    table = lambda rows: "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, (_, v) in rows.items()) + ")"
    among = lambda names: "tag IN (" + ", ".join(map(_text, names)) + ")"
    make(
        "vi_apply_tag",
        "s STRING, tag STRING",
        "STRING",
        f"""CASE WHEN {among(TONE_TAGS)} THEN vi_set_tone(s, CAST(array_position(array({', '.join(map(_text, TONE_TAGS))}), tag) - 1 AS INT))
            WHEN {among(INITIAL_TAGS)} THEN vi_put_initial(s, element_at({table(INITIAL_TAGS)}, tag), vi_initial(s))
            WHEN {among(FINAL_TAGS)} THEN concat(substr(s, 1, length(s) - length(vi_final(s))), element_at({table(FINAL_TAGS)}, tag)) ELSE s END""",
    )
    spark.udtf.register("vi_tokens", _Tokens)
