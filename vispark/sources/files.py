"""Readers and writers of the text formats, each with its schema stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vispark.functions.nfc import nfc
from vispark.functions.text import sentences

SAMPLE = "tokens array<string>, tags array<string>"
ANNOTATED = "text string, annotations array<struct<current_syllable: string, is_correct: boolean, alternative_syllables: array<string>>>"
# Fixed value: the marks stripped from both ends of an annotated token.
PUNCTUATION = ".,!?;:\"'()[]{}<>«»…-–—"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one sentence a line; blank lines are left out."""
    return spark.read.text(path).where(F.trim("value") != "")


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def read_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines of parallel tokens and tags; rows of unequal lengths are left out.  limit: the first so many lines, by file."""
    rows = spark.read.schema(SAMPLE).json(path)
    if limit is not None:
        order = rows.withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())
        rows = order.orderBy("_file", "_line").limit(limit).drop("_file", "_line")
    return rows.where(F.size("tokens") == F.size("tags"))


def write_samples(df: DataFrame, path: str) -> None:
    """JSON lines, one folder for each split."""
    df.select("split", "tokens", "tags").write.partitionBy("split").json(path)


def read_annotated(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """text, wrong, want: parallel arrays in normal form C; a token without an alternative, or whose alternative is only marks, is its own correction.

    Tokens that are only marks are left out, and rows without others.  split: mine or eval, by the hash of the text as it stands.
    """
    from vispark.operators.corpus import mine_split

    lines = spark.read.text(path)
    rows = lines.select(F.from_json("value", F.lit(f"struct<{ANNOTATED.replace('text string', 'text: string').replace('annotations array', 'annotations: array')}>")).alias("r"))
    if split is not None:
        rows = rows.where(mine_split(F.col("r.text")) == split)
    kind = "array<struct<current_syllable: string, is_correct: boolean, alternative_syllables: array<string>>>"
    rows = rows.select("r.text", F.from_json(nfc(F.to_json("r.annotations")), kind).alias("annotations"))
    clean = lambda s: F.trim(s, F.lit(PUNCTUATION))

    def pair(a):
        wrong = clean(a["current_syllable"])
        other = clean(F.try_element_at(a["alternative_syllables"], F.lit(1)))
        want = F.when(F.coalesce(a["is_correct"], F.lit(False)) | F.coalesce(other, F.lit("")).isin(""), wrong).otherwise(other)
        return F.struct(wrong.alias("w"), want.alias("c"))

    rows = rows.withColumn("p", F.filter(F.transform("annotations", pair), lambda x: x["w"] != "")).where(F.size("p") > 0)
    return rows.select("text", F.transform("p", lambda x: x["w"]).alias("wrong"), F.transform("p", lambda x: x["c"]).alias("want"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, cnt from tab-separated lines."""
    rows = spark.read.schema("word string, cnt long").option("sep", "\t").csv(path)
    return rows.select(F.lower(F.trim("word")).alias("word"), "cnt").where("word <> ''")


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Most frequent words first."""
    lexicon.orderBy(F.desc("cnt"), "word").select("word", "cnt").write.option("sep", "\t").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """key, weight from a JSON object of numbers; no rows if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, weight double")
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "weight"))


def write_weights(weights: DataFrame, path: str) -> None:
    """One JSON object; the table is as small as the set of keys."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "weight"))))
    weights.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)


def write_lexicon_json(lexicon: DataFrame, path: str) -> None:
    """One JSON array of the words in order; as small as a lexicon."""
    lexicon.agg(F.to_json(F.array_sort(F.collect_set("word"))).alias("value")).coalesce(1).write.text(path)


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("word")).select(F.lower("word").alias("word"))


def write_report(report: DataFrame, path: str, meta: dict[str, str]) -> None:
    """JSON lines of a report, each with what it was made from, as _meta."""
    report.withColumn("_meta", F.create_map(*[F.lit(v) for kv in sorted(meta.items()) for v in kv])).write.json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _meta map<string, string>").json(path)


def corpus_sentences(docs: DataFrame, target: int | None = None) -> DataFrame:
    """doc_id, sentence from whole documents.  target: so many at most, which ends the scan early; which ones is then left open."""
    out = docs.select("doc_id", F.explode(sentences(F.col("text"))).alias("sentence"))
    return out if target is None else out.limit(target)


def last_lines(rows: DataFrame, order: str, n: int = 40, by: list[str] | None = None) -> DataFrame:
    """The last n rows by order: what a log of n lines keeps.  by: of each group."""
    if not by:
        return rows.orderBy(F.desc(order)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def settings_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: a store after its changes (key, value, seq): the latest counts, and a null value removes the key."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    return stored.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last.where("value is not null"))


# What fields are never read: types, autocomplete values, words in their names; and the shortest text.
BLOCKED_TYPES = (
    "password", "hidden", "email", "tel", "number", "url", "date", "time", "datetime-local", "month", "week", "color", "range", "file", "checkbox",
    "radio", "submit", "button", "reset", "image", "search",
)
BLOCKED_AUTOCOMPLETE = ("password", "current-password", "new-password", "one-time-code", "cc-number", "cc-exp", "cc-csc", "cc-name", "cc-type")
BLOCKED_HINTS = (
    "search", "tìm kiếm", "tim kiem", "query", "otp", "captcha", "code", "mã", "coupon", "promo", "card", "cvv", "cvc", "iban", "swift",
)
MIN_LENGTH = 12


def eligible(fields: DataFrame) -> DataFrame:
    """Fields whose text may be read.

    fields: tag, type, autocomplete, hints (names and labels, joined), editable (the root of an editable area), locked (disabled, read
    only or switched off), code (within a code editor), text.  Whatever is in doubt stays out.
    """
    none = lambda c, words: ~F.greatest(F.lit(False), *[F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words])
    kind = F.coalesce(F.lower("type"), F.lit("text"))
    readable = (
        F.when(F.lower("tag") == "textarea", True)
        .when(F.lower("tag") == "input", (kind == "text") & ~kind.isin(*BLOCKED_TYPES))
        .otherwise(F.coalesce("editable", F.lit(False)))
    )
    safe = ~F.coalesce("locked", F.lit(False)) & ~F.coalesce("code", F.lit(False)) & none(F.col("autocomplete"), BLOCKED_AUTOCOMPLETE) & none(F.col("hints"), BLOCKED_HINTS)
    return fields.where(safe & readable & (F.length("text") >= MIN_LENGTH))


_SKIPPED, _BLOCKS = {"script", "style", "code", "pre"}, {"div", "p", "li", "br"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def html_nodes(html: str | None) -> list[tuple[int, int, str]]:
    """(start, end, text) of the text nodes of a page, in the text that they make up: a line end where a block ends; none behind text that is in no block.

    Nodes within script, style, code and pre are left out; character references are resolved.
    """
    from html.parser import HTMLParser

    nodes: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []
    state = {"at": 0, "block": -1, "line": True, "seen": 0}

    class Walk(HTMLParser):
        def handle_starttag(self, tag, attrs):
            state["seen"] += 1
            if tag not in _VOID:
                stack.append((tag, state["seen"]))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t in _SKIPPED for t, _ in stack):
                return
            block = next((i for t, i in reversed(stack) if t in _BLOCKS), 0)
            if state["block"] > 0 and block != state["block"] and not state["line"]:
                state["at"] += 1
            state["block"] = block
            nodes.append((state["at"], state["at"] + len(data), data))
            state["at"] += len(data)
            state["line"] = data.endswith("\n")

    walk = Walk(convert_charrefs=True)
    walk.feed(html or "")
    walk.close()
    return nodes


def text_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, node from 0, start, end, data: where each text node of a page lies in its text; in Arrow batches."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = [(k, i, a, b, t) for k, h in zip(frame["k"], frame["h"]) for i, (a, b, t) in enumerate(html_nodes(h))]
            yield pd.DataFrame(out, columns=[key, "node", "start", "end", "data"])

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h"))
    return rows.mapInPandas(run, f"{key} long, node int, start int, end int, data string")


def page_text(html):
    """Text of an HTML column: script, style, code and pre go, block tags become line ends, other tags nothing."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|code|pre)\b.*?</\1\s*>", "")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|blockquote)\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"<[^>]*>", ""), r"\s*\n\s*", "\n"))
