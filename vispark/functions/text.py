"""Tokens, sentences and cleaning, as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.functions.alphabet import TONED

# A token (a run of letters and marks), the end of a sentence in a gap, signs that make a sentence unfit for the
# corpus, letters that only accented writing has.
TOKEN = r"[\p{L}\p{M}]+"
GAP_END = r"[.!?…\n]"
BAD_SIGNS = r"[<>{}\[\]|=\\/@#*_~^]"
ACCENTED = f"[{TONED}ăâêôơưđĂÂÊÔƠƯĐ]"


def tokens(text: Column) -> Column:
    """Array of the tokens of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def gaps(text: Column) -> Column:
    """What stands before, between and behind the tokens: one more than there are tokens."""
    return F.split(F.coalesce(text, F.lit("")), TOKEN, -1)


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, which are generated: the optimizer does not merge projections across that, so each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def running_sums(df: DataFrame, values: str, name: str) -> DataFrame:
    """df with name: for each element of the array of integers, the sum of those before it.

    A fold that appends to an array copies it each time.  So it runs within blocks of about the cube root of n elements, and over the
    blocks' totals: n ** (4 / 3) steps, and no exchange.
    """
    append = lambda a, x: F.array_append(a, F.element_at(a, -1) + x)
    df = apart(df, _width=F.greatest(F.lit(8), F.ceil(F.cbrt(F.size(values))).cast("int")))
    block = lambda i: F.slice(values, i * F.col("_width") + 1, F.col("_width"))
    count = F.ceil(F.size(values) / F.col("_width")).cast("int")
    totals = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.aggregate(block(i), F.lit(0), lambda a, x: a + x))
    df = apart(df, _totals=F.when(F.size(values) > 0, F.aggregate(totals, F.array(F.lit(0)), append)))
    inner = lambda i: F.aggregate(block(i), F.array(F.get("_totals", i)), append, lambda a: F.slice(a, F.lit(1), F.size(a) - 1))
    sums = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_totals") - 2), inner))
    return apart(df, **{name: F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<int>"))}).drop("_width", "_totals")


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos from 0, tok, lower: one row a token."""
    rows = docs.select(F.col(key), F.posexplode(tokens(F.col(text))).alias("pos", "tok"))
    return rows.select(key, "pos", "tok", F.lower("tok").alias("lower"))


def with_starts(rows: DataFrame) -> DataFrame:
    """rows (_toks, _gaps) with _before, the length of the text before each token's gap."""
    lens = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_toks")), "_toks", lambda g, t: F.length(g) + F.length(t))
    return running_sums(apart(rows, _lens=lens), "_lens", "_before").drop("_lens")


def token_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = 0) -> DataFrame:
    """token_rows with start, end (code points, end exclusive) and gap, the text before the token; made within the row, without an exchange.

    near: also columns near_0, near_1, ... of the lower-case tokens from `near` places before to `near` places behind, without the token.
    """
    rows = apart(docs.select(F.col(key), F.col(text)), _toks=tokens(F.col(text)), _gaps=gaps(F.col(text))).drop(text).where(F.size("_toks") > 0)
    n, around = F.size("_toks"), {}
    for d in (*range(-near, 0), *range(1, near + 1)):
        moved = F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), -d), "_toks"), F.lit(1), n) if d < 0 else F.slice("_toks", F.lit(d + 1), n)
        around[f"near_{d + near}"] = moved
    zipped = F.arrays_zip(F.col("_toks").alias("tok"), F.slice("_gaps", F.lit(1), n).alias("gap"), F.col("_before").alias("at"), *[c.alias(name) for name, c in around.items()])
    rows = with_starts(rows).select(key, F.posexplode(zipped).alias("pos", "t"))
    start = F.col("t.at") + F.length("t.gap")
    return rows.select(
        key, "pos", F.col("t.tok").alias("tok"), F.lower("t.tok").alias("lower"), F.col("t.gap").alias("gap"), start.alias("start"), (start + F.length("t.tok")).alias("end"),
        *[F.lower(f"t.{name}").alias(name) for name in around],
    )


def sentence_numbers(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """token_spans with sent: a sentence ends where the gap has one of . ! ? … or a line end, also within a number such as 3.5."""
    cut = (F.col("pos") > 0) & F.col("gap").rlike(GAP_END)
    return spans.withColumn("sent", F.sum(F.when(cut, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos")))


def is_word(token: Column) -> Column:
    """Whether a string is letters and marks only, and not empty."""
    return token.rlike(rf"^{TOKEN}$")


def rebuild(gaps_: Column, toks: Column) -> Column:
    """The text of gaps (one more than tokens) and tokens, as they alternate."""
    n = F.size(toks)
    return F.concat(F.array_join(F.zip_with(F.slice(gaps_, F.lit(1), n), toks, lambda g, t: F.concat(g, t)), ""), F.element_at(gaps_, -1))


def replace_span(text: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with the code points from start to end (exclusive) replaced."""
    return F.overlay(text, new, start + 1, end - start)


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def sentences(text: Column) -> Column:
    """Sentences: split behind . ! ? and white space before a capital; white space becomes single blanks."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+(?=[A-ZÀ-Ỹ])", -1)
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def is_clean(sentence: Column, min_tokens: int = 6, max_tokens: int = 48, accented: float = 0.60) -> Column:
    """Whether a sentence is fit for the corpus, the cheap conditions first."""
    toks = tokens(sentence)
    n = F.size(toks)
    share = lambda good: F.size(F.filter(toks, good)) / n
    return (
        (F.length(sentence) >= 20)
        & ~sentence.rlike(BAD_SIGNS)
        & n.between(min_tokens, max_tokens)
        & (share(lambda w: w.rlike(ACCENTED)) >= accented)
        & (share(lambda w: F.length(w) > 7) <= 0.12)
        & (F.length(F.regexp_replace(sentence, r"\P{Nd}", "")) / F.length(sentence) <= 0.08)
    )


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys: the same on any partitioning, and in other SQL engines."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def hash_below(share: float, seed: int, *keys: Column) -> Column:
    """unit_hash(seed, *keys) < share, for a share from 0 to less than 1, told by the hash's digits without making a number of them."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.sha2(joined, 256) < F.lit(f"{math.ceil(share * 2**32):08x}")


def first_byte(text: Column) -> Column:
    """The first byte of the text's SHA-256, 0 to 255."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int")
