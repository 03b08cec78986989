"""Personal data by candidate gradient boosting, in SQL expressions.

Generators with high recall propose spans, which may overlap; boosted trees over the span's format and its
surroundings score each, and a threshold calibrated for each kind selects what is redacted.  The trees are fitted
anew on a fixed, labelled set of made-up spans (see pii_training), whose features the very same expressions
compute, and become CASE expressions: no row leaves the JVM, and no document is shuffled.

Strictly formed addresses and numbers (the base) are always found; the generators add to them.

Patterns use possessive loops where nothing could be given back, and a start behind a character that cannot begin
a span only at the end of the last match, so that long texts cost neither stack nor quadratic time.  Positions are running sums in
blocks, and proposals within base spans are found by running maxima: n matches cost n ** (4 / 3) steps.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vispark.llm.boosting import BoostedTrees
from vispark.llm.common import whole_text
from vispark.llm.pii_training import PLACED, labelled_spans

#: Kinds in the order of the result: the base's, then those that only the generators know.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
CONTEXT_CHARS = 24
MIN_PRECISION = 0.98


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: A cheap condition on the text without which nothing can match.
    when: str


_DIGITS = "text rlike '[0-9]'"
BASE = (
    Generator("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0"),
    Generator("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "instr(text, '.') > 0 and " + _DIGITS),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", _DIGITS),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0"),
)
PROPOSED = (
    Generator(
        "email",
        r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]++"
        r"(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
        r"text rlike '(?i)[(\\[]at[)\\]]|\\x20at\\x20|@'",
    ),
    Generator("phone", r"(?<![0-9A-Za-z+.@-])\(?[0-9]{2,4}\)?(?:[\x20.-]?\(?[0-9]{2,4}\)?){1,5}(?![0-9A-Za-z])", _DIGITS),
    Generator("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])", _DIGITS),
    Generator("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "instr(text, ':') > 0 and " + _DIGITS),
    Generator("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,4})?(?![0-9A-Za-z])", _DIGITS),
    Generator(
        "secret",
        r"(?i)(?:token|key|secret|password|passwd)[\x22\x27]?\x20{0,2}[:=]\x20{0,2}[\x22\x27]?[A-Za-z0-9_/+-]{12,}+",
        "(instr(text, '=') > 0 or instr(text, ':') > 0)",
    ),
    Generator("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "instr(text, '-') > 0 and " + _DIGITS),
)

_SPANS = "array<struct<s: int, e: int, str: string, before: string, after: string>>"


def _matches(g: Generator, name: str) -> tuple[tuple[str, str], ...]:
    """Columns (name, SQL) of a generator's matches and the stretches of text between them."""
    found = f"CASE WHEN {g.when} THEN regexp_extract_all(text, r'{g.pattern}', 0) ELSE CAST(array() AS array<string>) END"
    return (f"{name}_m", found), (f"{name}_g", f"CASE WHEN size({name}_m) > 0 THEN split(text, r'{g.pattern}', -1) END")


def _running(values: str, name: str, op: str) -> tuple[tuple[str, str], tuple[str, str], tuple[str, str]]:
    """Columns (name, SQL), one after another, of which the last has op over all values before each one (0 before the first).

    A fold that appends to an array copies it each time.  So it runs within blocks of about the cube root of n values, and over the
    blocks' totals: n ** (4 / 3) steps in all.  Each column is used twice by the next, or the optimizer would put it into the lambda.
    """
    v, t, append = f"{name}_v", f"{name}_t", f"(a, x) -> array_append(a, {op.format('element_at(a, -1)', 'x')})"
    width = f"int(greatest(8, ceil(cbrt(size({v})))))"
    block = f"slice({v}, i * {width} + 1, {width})"
    totals = f"transform(sequence(0, int(ceil(size({v}) / {width})) - 1), i -> aggregate({block}, 0, (a, x) -> {op.format('a', 'x')}))"
    inner = f"aggregate({block}, array({t}[i]), {append}, a -> slice(a, 1, size(a) - 1))"
    return (
        (v, values),
        (t, f"CASE WHEN size({v}) > 0 THEN aggregate({totals}, array(0), {append}) END"),
        (f"{name}_p", f"CASE WHEN size({v}) > 0 THEN flatten(transform(sequence(0, size({t}) - 2), i -> {inner})) ELSE CAST(array() AS array<int>) END"),
    )


_ADD, _MOST = "{} + {}", "greatest({}, {})"


def _lengths(name: str) -> str:
    """SQL: how far each match brings us on, with the stretch before it."""
    m = f"{name}_m"
    return f"CASE WHEN size({m}) > 0 THEN zip_with({m}, slice({name}_g, 1, size({m})), (x, y) -> length(x) + length(y)) ELSE CAST(array() AS array<int>) END"


def _spans(name: str) -> str:
    """SQL of a generator's spans, with what stands before and behind them."""
    m, g, p = f"{name}_m", f"{name}_g", f"{name}_p"
    one = (
        f"z -> named_struct('s', z.`3` + length(z.`1`), 'e', z.`3` + length(z.`1`) + length(z.`0`), 'str', z.`0`, "
        f"'before', right(z.`1`, {CONTEXT_CHARS}), 'after', left(z.`2`, 1))"
    )
    zipped = f"arrays_zip(slice({m}, 1, size({m})), slice({g}, 1, size({m})), slice({g}, 2, size({m})), slice({p}, 1, size({m})))"
    return f"CASE WHEN size({m}) = 0 THEN CAST(array() AS {_SPANS}) ELSE transform({zipped}, {one}) END"


def _luhn(digits: str) -> str:
    """SQL: whether a string of at most 20 digits passes Luhn's check; zeros in front change nothing."""
    even = f"aggregate(split(regexp_replace(lpad({digits}, 20, '0'), '([0-9])[0-9]', '$1'), ''), 0, (a, c) -> a + int(translate(c, '0123456789', '0246813579')))"
    odd = f"aggregate(split(regexp_replace(lpad({digits}, 20, '0'), '[0-9]([0-9])', '$1'), ''), 0, (a, c) -> a + int(c))"
    return f"(({even} + {odd}) % 10 = 0)"


_D = "regexp_replace(x.str, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"x.str rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$'",
    "card": f"length({_D}) BETWEEN 16 AND 19 AND {_luhn(_D)}",
    "phone": f"length({_D}) BETWEEN 8 AND 15",
}

#: Features of a proposed span x (with its digits d and its generator's number): all numbers.
FEATURES = (
    "length(x.str)",
    "length(x.d)",
    "length(regexp_replace(x.str, '[^A-Za-z]', ''))",
    "length(x.str) - length(replace(x.str, ' ', ''))",
    "length(x.str) - length(replace(x.str, '.', ''))",
    "length(x.str) - length(replace(x.str, '-', ''))",
    f"int(length(x.d) BETWEEN 12 AND 20 AND {_luhn('left(x.d, 20)')})",
    "size(array_distinct(split(x.d, '')))",
    "coalesce(try_cast(left(x.d, 1) AS int), -1)",
    "coalesce(try_cast(left(x.d, 4) AS int), -1)",
    "int(x.before rlike '(?i)(call|tel|phone|fax|mobile|contact|mail|card|visa|iban|ssn|social|account|login)')",
    "int(x.before rlike '(?i)(isbn|order|version|invoice|date|page|part|serial|year|between|from|item)')",
    "int(x.before rlike '[A-Za-z0-9]$')",
    "int(x.before rlike '[#$:=/]$')",
    "int(x.after rlike '[A-Za-z0-9%]')",
    "instr(x.str, '(')",
    "int(x.str rlike '(?i)[(\\\\[](at|dot)[)\\\\]]')",
    "int(x.str rlike '(?i)(com|org|net|edu|de|fr|es|io|gov|uk)$')",
    "coalesce(array_max(transform(regexp_extract_all(x.str, '[0-9]+', 0), y -> length(y))), 0)",
    "size(regexp_extract_all(x.str, '[0-9]+', 0))",
    "int(x.str rlike '[0-9a-fA-F]{16,}$')",
    "length(x.d) / length(x.str)",
    "size(array_distinct(split(right(x.str, 40), '')))",
    "length(regexp_extract(x.str, '([0-9]*)$', 1))",
    f"int(x.str rlike '(?i)^({'|'.join(PLACED)}) at ')",
)


def _featured(spans: str, generator: str) -> str:
    """SQL: spans with their digits and features f0, f1, ...; f0 is the generator's number."""
    with_digits = f"transform({spans}, x -> struct(x.*, {_D} AS d))".replace("struct(x.*, ", "named_struct('s', x.s, 'e', x.e, 'str', x.str, 'before', x.before, 'after', x.after, 'd', ").replace(" AS d))", "))")
    fields = ", ".join(f"'f{i}', double({sql})" for i, sql in enumerate((generator, *FEATURES)))
    return f"transform({with_digits}, x -> named_struct('s', x.s, 'e', x.e, {fields}))"


def fit_span_model(spark: SparkSession) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees, and each kind's calibrated threshold on their score; a generator's kind decides."""
    rows = labelled_spans()
    schema = "array<struct<gen: int, str: string, before: string, after: string, label: int>>"
    one = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(schema))))
    spans = "array(named_struct('s', 0, 'e', 0, 'str', str, 'before', before, 'after', after))"
    seen = one.select("label", "gen", F.expr(f"{_featured(spans, 'gen')}[0]").alias("f")).collect()
    width = len(FEATURES) + 1
    x = [[r.f[f"f{i}"] for i in range(width)] for r in seen]
    y = [r.label for r in seen]
    train = [i for i in range(len(x)) if i % 3]
    held = [i for i in range(len(x)) if i % 3 == 0]
    trees = BoostedTrees.fit([x[i] for i in train], [y[i] for i in train])
    scores = trees.scores([x[i] for i in held])
    cuts = {}
    for kind in KINDS:
        own = [k for k, i in enumerate(held) if PROPOSED[int(x[i][0])].kind == kind]
        cuts[kind] = trees.calibrated_cut([scores[k] for k in own], [y[held[k]] for k in own], MIN_PRECISION)
    return trees, cuts


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text, base and spans, arrays of (kind, start, end), ordered by kind and start.

    Positions are code points, the end exclusive.  base has the strictly formed spans of four kinds, each leftmost and
    non-overlapping of its kind; spans has these and the selected proposals that lie in none of them.  Null text counts as empty
    and has no spans; other columns are ignored; repeated rows give repeated results; an empty table no rows.
    """
    trees, cuts = fit_span_model(docs.sparkSession)
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    names = [(f"b{i}", g) for i, g in enumerate(BASE)] + [(f"p{i}", g) for i, g in enumerate(PROPOSED)]
    for at in (0, 1):
        df = df.select("*", *[F.expr(sql).alias(name) for n, g in names for name, sql in _matches(g, n)[at : at + 1]])
    for at in (0, 1, 2):
        df = df.select("*", *[F.expr(sql).alias(name) for n, _ in names for name, sql in _running(_lengths(n), n, _ADD)[at : at + 1]])
    df = df.select("doc_id", "text", *[F.expr(_spans(n)).alias(n) for n, _ in names])
    df = df.select(
        "doc_id",
        "text",
        *[F.expr(f"filter({n}, x -> {_VALID[g.kind]})").alias(n) for n, g in names if n[0] == "b"],
        *[F.expr(_featured(n, n[1:])).alias(n) for n, _ in names if n[0] == "p"],
    )
    score = trees.sql("x")
    plain = lambda n, g: f"transform({n}, x -> named_struct('k', {KINDS.index(g.kind)}, 's', x.s, 'e', x.e))"
    chosen = lambda n, g: f"filter({n}, x -> {score} >= {cuts[g.kind]!r}D)"
    df = df.select(
        "doc_id",
        "text",
        F.expr("concat(" + ", ".join(plain(n, g) for n, g in names if n[0] == "b") + ")").alias("base"),
        F.expr("concat(" + ", ".join(plain(chosen(n, g), g) for n, g in names if n[0] == "p") + ")").alias("more"),
    )
    # a proposal lies in a base span if, in the order of their starts, some base span before it ends no earlier
    entry = "transform({0}, x -> named_struct('s', x.s, 'more', {1}, 'e', x.e, 'k', x.k))"
    both = f"concat({entry.format('base', 0)}, {entry.format('more', 1)})"
    df = df.select("doc_id", "text", "base", F.expr(f"CASE WHEN size(more) = 0 THEN slice({both}, 1, 0) ELSE array_sort({both}) END").alias("both"))
    for name, sql in _running("transform(both, x -> IF(x.more = 0, x.e, 0))", "both", _MOST):
        df = df.select("*", F.expr(sql).alias(name))
    outside = "filter(arrays_zip(both, both_p), z -> z.both.more = 1 AND z.both_p < z.both.e)"
    added = f"transform({outside}, z -> named_struct('k', z.both.k, 's', z.both.s, 'e', z.both.e))"
    df = df.select("doc_id", "text", "base", F.expr(f"CASE WHEN size(both) = 0 THEN base ELSE array_sort(concat(base, {added})) END").alias("spans"))
    df = df.select("doc_id", "text", "base", F.expr("filter(spans, (x, i) -> i = 0 OR x <> spans[i - 1])").alias("spans"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    named = f"x -> named_struct('kind', {kinds}[x.k], 'start', x.s, 'end', x.e)"
    return df.select("doc_id", "text", F.expr(f"transform(base, {named})").alias("base"), F.expr(f"transform(spans, {named})").alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """find_pii's rows as doc_id, text, with each span replaced by its kind in brackets; of overlapping ones the first."""
    fold = (
        "aggregate(array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))), "
        "named_struct('at', 0, 'out', ''), (a, x) -> CASE WHEN x.start < a.at THEN a ELSE "
        "named_struct('at', x.end, 'out', concat(a.out, substring(text, a.at + 1, x.start - a.at), '[', upper(x.kind), ']')) END, "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return found.select("doc_id", F.expr(fold).alias("text"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """find_pii's spans as counts, a checksum of the base and one string of all spans."""
    found = find_pii(docs)
    joined = lambda a: F.expr(f"array_join(transform({a}, x -> concat_ws(':', x.kind, string(x.start), string(x.end))), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
