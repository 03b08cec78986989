"""Rule checks: wrong phrases, and homophones decided by the words around them.

The built-in tables are small and fixed, so check_text looks them up within the document's row: tokens are arrays, the tables map
literals, and a document without any candidate word is dropped before anything else is made of it.  No exchange is needed.
For tables of any size there are joins over token rows (phrase_hits, cue_scores, context_hits).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vispark.functions.syllable import match_case
from vispark.functions.text import apart, gaps, token_spans, tokens, with_starts
from vispark.operators.issues import dedupe_issues, without_overlaps
from vispark.operators.rule_tables import PAIRS, PHRASES

MAX_WORDS, CUE_WINDOW, MARGIN = 3, 3, 2
PHRASE_CONFIDENCE = 0.99
_NEAR = (*range(-CUE_WINDOW, 0), *range(1, CUE_WINDOW + 1))
_PHRASE = "key string, n int, right string, tag string, why string"
_CUES = "before array<string>, after array<string>, other_before array<string>, other_after array<string>"
_PAIR = f"entry int, tag string, form string, gloss string, strict boolean, other string, other_gloss string, {_CUES}"


def _phrase_rows(phrases=PHRASES) -> list[tuple]:
    return [(w, len(w.split(" ")), r, t, why) for w, r, t, why in phrases]


def _pair_rows(pairs=PAIRS) -> list[tuple]:
    """One row for each form and entry: the form, the other one, and the cue words of both."""
    rows = []
    for i, (tag, *forms) in enumerate(pairs):
        for own, other in (forms, forms[::-1]):
            (name, gloss, strict, before, after), (o_name, o_gloss, _, o_before, o_after) = own, other
            rows.append((i, tag, name, gloss, strict, o_name, o_gloss, *map(list, (before, after, o_before, o_after))))
    return rows


def phrase_table(spark: SparkSession, phrases=PHRASES) -> DataFrame:
    return spark.createDataFrame(_phrase_rows(phrases), _PHRASE)


def pair_table(spark: SparkSession, pairs=PAIRS) -> DataFrame:
    return spark.createDataFrame(_pair_rows(pairs), _PAIR)


def rule_statistics(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """phrases, longest (words), pairs, forms (different ones), strict_forms."""
    p = phrases.agg(F.count("*").alias("phrases"), F.max("n").alias("longest"))
    c = pairs.agg(F.count_distinct("entry").alias("pairs"), F.count_distinct("form").alias("forms"), F.count_if("strict").alias("strict_forms"))
    return p.crossJoin(c)  # one row each


def phrase_hits(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """token_spans -> doc_id, pos, n, start, end, original, right, tag, why: phrases from the left, the longest first, none overlapping.

    A phrase is words joined by single blanks, whatever stood between them in the text.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    key, original, grams = F.col("lower"), F.col("tok"), []
    for n in range(1, MAX_WORDS + 1):
        if n > 1:
            key = F.concat(key, F.lit(" "), F.lead("lower", n - 1).over(by_doc))
            original = F.concat(original, F.lead("gap", n - 1).over(by_doc), F.lead("tok", n - 1).over(by_doc))
        last = F.lead("end", n - 1).over(by_doc) if n > 1 else F.col("end")
        grams.append(F.struct(F.lit(n).alias("n"), key.alias("key"), last.alias("end"), original.alias("original")))
    rows = tokens.select("doc_id", "pos", "start", F.array(*grams).alias("grams"))
    rows = rows.select("doc_id", "pos", "start", F.explode("grams").alias("g")).where("g.key is not null")
    rows = rows.select("doc_id", "pos", "start", "g.n", "g.key", "g.end", "g.original")
    found = rows.join(phrases, ["key", "n"])
    entry = F.struct("pos", (-F.col("n")).alias("short"), "n", "start", "end", "original", "right", "tag", "why")
    kept = F.expr(
        "aggregate(array_sort(hits), named_struct('free', -1, 'out', slice(hits, 1, 0)), (a, h) -> CASE WHEN h.pos >= a.free "
        "THEN named_struct('free', h.pos + h.n, 'out', array_append(a.out, h)) ELSE a END, a -> a.out)"
    )
    folded = found.groupBy("doc_id").agg(F.collect_list(entry).alias("hits")).select("doc_id", F.explode(kept).alias("h"))
    return folded.select("doc_id", "h.pos", "h.n", "h.start", "h.end", "h.original", "h.right", "h.tag", "h.why")


def cue_scores(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each form's score and its rival's: cue words within three tokens, the next ones counting double.

    tokens: token_spans; if it was made with near=CUE_WINDOW, no tokens are exchanged to find their neighbours.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    at = lambda d: F.lag("lower", -d).over(by_doc) if d < 0 else F.lead("lower", d).over(by_doc)
    rows = tokens if f"near_{2 * CUE_WINDOW}" in tokens.columns else tokens.select("*", *[at(d).alias(f"near_{d + CUE_WINDOW}") for d in _NEAR])
    rows = rows.join(pairs, rows["lower"] == pairs["form"])
    near = lambda d: F.col(f"near_{d + CUE_WINDOW}")
    own = _cue_sum(F.col("before"), F.col("after"), near)
    return rows.withColumn("self_score", own).withColumn("other_score", _cue_sum(F.col("other_before"), F.col("other_after"), near))


def _cue_sum(before: Column, after: Column, near) -> Column:
    total = F.lit(0)
    for d in _NEAR:
        hit = F.array_contains(before if d < 0 else after, near(d))
        total = total + F.when(hit, 2 if abs(d) == 1 else 1).otherwise(0)
    return total


def _confidence(strict: Column, own: Column, rival: Column) -> Column:
    """Of a suspicion; null if there is none.  A strict form needs a cue of its own; the others' rival must lead by MARGIN."""
    lead = rival - own
    return (
        F.when(strict & (own > 0), None)
        .when(strict, F.when(rival > 0, 0.93).otherwise(0.88))
        .when(lead >= MARGIN, F.when(lead >= 4, 0.90).otherwise(0.85))
    )


def context_hits(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, other, tag, confidence, gloss, other_gloss: the best entry of each suspicious form."""
    scored = cue_scores(tokens, pairs)
    confidence = _confidence(F.col("strict"), F.col("self_score"), F.col("other_score"))
    rows = scored.withColumn("confidence", confidence).where("confidence is not null")
    best = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("confidence"), "entry"))
    columns = ["doc_id", "pos", "start", "end", "tok", "lower", "other", "tag", "confidence", "gloss", "other_gloss"]
    return rows.withColumn("best", best).where("best = 1").select(*columns)


def _why(other: Column, other_gloss: Column, form: Column, gloss: Column) -> Column:
    return F.format_string('"%s" — %s. "%s" — %s.', other, other_gloss, form, gloss)


def rule_issues(docs: DataFrame, phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and the fields of an issue: all phrase hits, and context hits on tokens that no phrase took; by joins."""
    spans = token_spans(docs, near=CUE_WINDOW)
    hits = phrase_hits(spans, phrases)
    taken = hits.select("doc_id", F.explode(F.expr("sequence(pos, pos + n - 1)")).alias("pos"))
    context = context_hits(spans, pairs).join(taken, ["doc_id", "pos"], "left_anti")
    why = _why(F.col("other"), F.col("other_gloss"), F.col("lower"), F.col("gloss"))
    found = hits.select("doc_id", "start", "end", "original", F.col("right").alias("new"), "why", "tag", F.lit(PHRASE_CONFIDENCE).alias("confidence"))
    found = found.unionByName(context.select("doc_id", "start", "end", F.col("tok").alias("original"), F.col("other").alias("new"), why.alias("why"), "tag", "confidence"))
    return found.select(
        "doc_id", "start", "end", "original", match_case(F.col("original"), F.col("new")).alias("suggestion"), "why", "tag", "confidence", F.lit("rule").alias("source")
    )


def _table(rows: list[tuple], schema: str, key: str, many: bool) -> Column:
    """A map literal from key to a row, or to the rows, of a fixed table."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    out: dict = {}
    for row in rows:
        entry = dict(zip(names, row))
        if many:
            out.setdefault(entry[key], []).append(entry)
        else:
            out.setdefault(entry[key], entry)
    fields = schema.replace(" ", ": ").replace(",: ", ", ")
    kind = f"map<string, {'array<' * many}struct<{fields}>{'>' * many}>"
    return F.from_json(F.lit(json.dumps(out, ensure_ascii=False)), kind)


def issues_in_row(docs: DataFrame, phrases=PHRASES, pairs=PAIRS) -> DataFrame:
    """rule_issues without overlaps, from tables as tuples, without an exchange.

    A homophone within a phrase is left to the phrase: it starts no earlier, and of equal starts the longer and surer issue wins.
    """
    firsts = sorted({w.split(" ")[0] for w, *_ in phrases} | {form[0] for _, *forms in pairs for form in forms})
    by_key, by_form = _table(_phrase_rows(phrases), _PHRASE, "key", False), _table(_pair_rows(pairs), _PAIR, "form", True)
    rows = apart(docs.select("doc_id", "text"), _toks=tokens(F.col("text")))
    marked = F.transform("_toks", lambda w, i: F.when(F.lower(w).isin(*firsts), i).otherwise(-1))
    rows = apart(rows, _at=F.filter(marked, lambda i: i >= 0)).where(F.size("_at") > 0)
    rows = apart(rows, _low=F.transform("_toks", lambda w: F.lower(w)), _gaps=gaps(F.col("text")))
    rows = with_starts(rows)
    low, tok, gap = (lambda i: F.get("_low", i)), (lambda i: F.get("_toks", i)), (lambda i: F.get("_gaps", i))
    start = lambda i: F.get("_before", i) + F.length(gap(i))
    issue = lambda i, last, original, new, why, tag, confidence: F.struct(
        start(i).alias("start"), (start(last) + F.length(tok(last))).alias("end"), original.alias("original"), match_case(original, new).alias("suggestion"),
        why.alias("why"), tag.alias("tag"), confidence.alias("confidence"), F.lit("rule").alias("source"),
    )

    def longest(i: Column) -> Column:
        key, found = low(i), []
        for n in range(1, MAX_WORDS + 1):
            found.append(F.try_element_at(by_key, key))
            key = F.concat(key, F.lit(" "), low(i + n))
        return F.coalesce(*found[::-1])

    def phrase_issue(h: Column) -> Column:
        i, p = h["i"], h["p"]
        two = F.concat(tok(i), gap(i + 1), tok(i + 1))
        original = F.when(p["n"] == 1, tok(i)).when(p["n"] == 2, two).otherwise(F.concat(two, gap(i + 2), tok(i + 2)))
        return issue(i, i + p["n"] - 1, original, p["right"], p["why"], p["tag"], F.lit(PHRASE_CONFIDENCE))

    def suspicion(i: Column) -> Column:
        near = lambda d: low(i + d)
        score = lambda e: _confidence(e["strict"], _cue_sum(e["before"], e["after"], near), _cue_sum(e["other_before"], e["other_after"], near))
        scored = F.transform(F.coalesce(F.try_element_at(by_form, low(i)), F.array()), lambda e: F.struct(score(e).alias("c"), (-e["entry"]).alias("first"), e.alias("e")))
        return F.array_max(F.transform(F.filter(scored, lambda x: x["c"].isNotNull()), lambda x: F.struct(x["c"].alias("c"), x["first"].alias("first"), *[x["e"][f].alias(f) for f in ("other", "tag", "gloss", "other_gloss")])))

    def context_issue(h: Column) -> Column:
        i, s = h["i"], h["s"]
        return issue(i, i, tok(i), s["other"], _why(s["other"], s["other_gloss"], low(i), s["gloss"]), s["tag"], s["c"])

    rows = apart(
        rows,
        _phrases=F.filter(F.transform("_at", lambda i: F.struct(i.alias("i"), longest(i).alias("p"))), lambda h: h["p"].isNotNull()),
        _context=F.filter(F.transform("_at", lambda i: F.struct(i.alias("i"), suspicion(i).alias("s"))), lambda h: h["s"].isNotNull()),
    ).where((F.size("_phrases") > 0) | (F.size("_context") > 0))
    every = F.concat(F.transform("_phrases", phrase_issue), F.transform("_context", context_issue))
    order = lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("short"), (-x["confidence"]).alias("doubt"), x["source"].alias("source"), x["suggestion"].alias("suggestion"))
    rows = apart(rows, all=F.array_sort(F.transform(every, lambda x: F.struct(order(x).alias("by"), x.alias("it")))))
    return without_overlaps(rows.select("doc_id", "all")).select("doc_id", "x.it.*")


def check_text(docs: DataFrame, min_confidence: float = 0.8, ignored: DataFrame | None = None, phrases=PHRASES, pairs=PAIRS) -> DataFrame:
    """The issues of each document, ordered and without overlaps.

    Overlaps are resolved before weak and ignored issues go, so an issue that goes may still have displaced another.
    ignored: a table of lower-case words.  phrases, pairs: tuples as in rule_tables, looked up within the row; or tables of any size
    (phrase_table, pair_table), which are joined with the tokens.
    """
    if isinstance(phrases, DataFrame) or isinstance(pairs, DataFrame):
        spark = docs.sparkSession
        as_table = lambda t, make: t if isinstance(t, DataFrame) else make(spark, t)
        out = dedupe_issues(rule_issues(docs, as_table(phrases, phrase_table), as_table(pairs, pair_table)))
    else:
        out = issues_in_row(docs, phrases, pairs)
    out = out.where(F.col("confidence") >= min_confidence)
    if ignored is not None:
        out = out.join(ignored.select(F.col("word").alias("_word")), F.lower("original") == F.col("_word"), "left_anti")
    return out
