"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

import unicodedata

from vispark.functions.alphabet import FINAL_TAGS, FINALS, FLATS, INITIAL_TAGS, INITIALS, TONE_TAGS, TONED, VOWELS, vowels
from vispark.operators.rule_tables import PAIRS, PHRASES
from vispark.plans.rule_texts import rule_texts

_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in VOWELS)

_TOKENS = r"""t AS (SELECT doc_id, pos, tok, lower(tok) AS lower FROM (
    SELECT doc_id, unnest(a) AS tok, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+') AS a FROM documents)))"""
_WORDS = _TOKENS + ", w AS (SELECT lower AS word, count(*) AS n FROM t GROUP BY 1)"
_GAPS = r"""s AS MATERIALIZED (SELECT doc_id, pos, tok, lower(tok) AS lower, gap,
    CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS "end" FROM (
    SELECT doc_id, unnest(a) AS tok, unnest(g[1:len(a)]) AS gap, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos FROM (
        SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+') AS a, regexp_split_to_array(text, '[\p{L}\p{M}]+') AS g
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM %s) WHERE len(regexp_extract_all(text, '[\p{L}\p{M}]+')) > 0)))"""


def _u(seed: int, *keys: str) -> str:
    joined = f"'{seed}|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(CAST('0x' || substr(sha256({joined}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


_PAIR = _TOKENS + f""", p AS (SELECT doc_id, pos, CASE WHEN {_u(3, 'doc_id', 'pos')} < 0.2 THEN prev ELSE lower END AS wrong, lower AS want FROM (
    SELECT *, lag(lower) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM t) WHERE prev IS NOT NULL)"""


def _got(name: str, seed: int) -> str:
    return f""", {name} AS (SELECT *, CASE WHEN wrong <> want AND u < 0.6 THEN want WHEN wrong <> want AND u < 0.7 THEN '?'
        WHEN wrong = want AND u < 0.01 THEN '?' ELSE wrong END AS got FROM (SELECT *, {_u(seed, 'doc_id', 'pos')} AS u FROM p))"""


_PRED = _PAIR + _got("q", 9)
_OUTCOME = """CASE WHEN wrong <> want AND got = want THEN 'fixed' WHEN wrong <> want AND got <> wrong THEN 'wrong_fix'
    WHEN wrong <> want THEN 'missed' WHEN got <> wrong THEN 'false_alarm' ELSE 'clean' END"""
_LOGITS = _TOKENS + f""", z AS (SELECT doc_id, pos, {', '.join(f"{_u(20 + i, 'doc_id', 'pos')} * 8.0 AS z{i}" for i in range(4))} FROM t),
    e AS (SELECT *, exp(z0 - m) AS e0, exp(z1 - m) AS e1, exp(z2 - m) AS e2, exp(z3 - m) AS e3 FROM (SELECT *, greatest(z0, z1, z2, z3) AS m FROM z)),
    g AS (SELECT doc_id, pos, e0 / (e0 + e1 + e2 + e3) AS keep_p, greatest(e1, e2, e3) / (e0 + e1 + e2 + e3) AS best_p,
          CASE WHEN e1 >= e2 AND e1 >= e3 THEN 'TONE_HOI' WHEN e2 >= e3 THEN 'CH_TR' ELSE 'N_NG' END AS best, z0, z1, z2, z3 FROM e)"""
_SPANS = _TOKENS + f""", i AS (SELECT doc_id, CAST(pos * 10 AS INTEGER) AS start, CAST(pos * 10 + floor({_u(41, 'doc_id', 'pos')} * 3) * 10 + 5 AS INTEGER) AS "end",
    round({_u(42, 'doc_id', 'pos')}, 2) AS confidence, CASE WHEN {_u(43, 'doc_id', 'pos')} < 0.5 THEN 'rule' ELSE 'model' END AS source, lower AS suggestion
    FROM t WHERE {_u(40, 'doc_id', 'pos')} < 0.3)"""
_PRE = r"^(" + "|".join(i for i in INITIALS if i not in ("gi", "qu")) + ")"
_INITIAL = f"""CASE WHEN regexp_matches(word, '^(gi|qu).*[{VOWELS}]') THEN substr(word, 1, 2) ELSE regexp_extract(word, '{_PRE}', 1) END"""
_FINAL = f"regexp_extract(word, '({'|'.join(FINALS)})$', 1)"
_TONE = f"""CASE WHEN regexp_extract(word, '[{TONED}]') <> '' THEN (instr('{TONED}', regexp_extract(word, '[{TONED}]')) - 1) // {len(FLATS)} + 1
    WHEN regexp_matches(word, '[{VOWELS}]') THEN 0 END"""


def _rule_docs() -> str:
    rows = ", ".join(f"({-1 - i}, {_text(t)})" for i, t in enumerate(rule_texts()))
    return f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}))"


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _phrase_hits(docs: str) -> str:
    """CTEs with f: phrase hits that are kept."""
    values = ", ".join(f"('{w}', {len(w.split(' '))}, '{r}', '{t}', {_text(why)})" for w, r, t, why in PHRASES)
    grams = " UNION ALL ".join(
        f"SELECT doc_id, pos, {n} AS n, {key} AS key FROM k" for n, key in ((1, "lower"), (2, "lower || ' ' || l1"), (3, "lower || ' ' || l1 || ' ' || l2"))
    )
    return f"""{_GAPS % docs},
        k AS (SELECT doc_id, pos, lower, lead(lower, 1) OVER v AS l1, lead(lower, 2) OVER v AS l2 FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
        r(wrong, n, "right", tag, why) AS (VALUES {values}),
        h AS (SELECT g.doc_id, g.pos, g.n, r."right", r.tag, r.why, row_number() OVER (PARTITION BY doc_id ORDER BY pos, g.n DESC) AS i
              FROM ({grams}) g JOIN r ON g.key = r.wrong AND g.n = r.n),
        f AS (SELECT doc_id, i, pos, n, "right", tag, why, true AS kept, pos + n AS free FROM h WHERE i = 1
              UNION ALL
              SELECT h.doc_id, h.i, h.pos, h.n, h."right", h.tag, h.why, h.pos >= f.free, CASE WHEN h.pos >= f.free THEN h.pos + h.n ELSE f.free END
              FROM f JOIN h ON h.doc_id = f.doc_id AND h.i = f.i + 1)"""


def _phrases() -> str:
    return f"""WITH RECURSIVE {_phrase_hits(_rule_docs())} SELECT doc_id, pos, n, "right" FROM f WHERE kept"""


def _context_hits() -> str:
    """CTEs with y: the best entry of each suspicious form; they follow those of the tokens."""
    rows = []
    for i, (tag, *forms) in enumerate(PAIRS):
        for own, other in (forms, forms[::-1]):
            lists = [f"[{', '.join(repr(c) for c in w)}]::VARCHAR[]" for w in (*own[3:], *other[3:])]
            rows.append(f"({i}, '{tag}', '{own[0]}', {_text(own[1])}, {own[2]}, '{other[0]}', {_text(other[1])}, {', '.join(lists)})")
    near = [d for d in range(-3, 4) if d]
    cols = ", ".join(f"lead(lower, {d}) OVER v AS a{d + 3}" if d > 0 else f"lag(lower, {-d}) OVER v AS a{d + 3}" for d in near)
    score = lambda b, a: " + ".join(f"CASE WHEN list_contains({b if d < 0 else a}, a{d + 3}) THEN {2 if abs(d) == 1 else 1} ELSE 0 END" for d in near)
    return f"""k2 AS (SELECT doc_id, pos, lower, {cols} FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
        r2(entry, tag, form, gloss, strict, other, other_gloss, b, a, ob, oa) AS (VALUES {', '.join(rows)}),
        x AS (SELECT doc_id, pos, lower, entry, tag, gloss, strict, other, other_gloss, {score('b', 'a')} AS own, {score('ob', 'oa')} AS rival FROM k2 JOIN r2 ON k2.lower = r2.form),
        c AS (SELECT *, CASE WHEN strict AND own > 0 THEN NULL WHEN strict THEN CASE WHEN rival > 0 THEN 0.93::DOUBLE ELSE 0.88::DOUBLE END
              WHEN rival - own >= 4 THEN 0.90::DOUBLE WHEN rival - own >= 2 THEN 0.85::DOUBLE END AS confidence FROM x),
        y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY confidence DESC, entry) AS n
              FROM c WHERE confidence IS NOT NULL) WHERE n = 1)"""


def _check_text() -> str:
    case = """CASE WHEN upper(o) = o AND lower(o) <> o THEN upper(new) WHEN substr(o, 1, 1) <> lower(substr(o, 1, 1)) THEN upper(substr(new, 1, 1)) || substr(new, 2) ELSE new END"""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM {_rule_docs()}), {_phrase_hits('d')}, {_context_hits()},
        kept AS MATERIALIZED (SELECT * FROM f WHERE kept), found AS MATERIALIZED (SELECT * FROM y), z AS (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM kept),
        p AS MATERIALIZED (SELECT doc_id, pos, pos + n - 1 AS last, "right" AS new, why, tag, 0.99::DOUBLE AS confidence FROM kept
              UNION ALL
              SELECT doc_id, pos, pos, other, '"' || other || '" — ' || other_gloss || '. "' || lower || '" — ' || gloss || '.', tag, confidence
              FROM found ANTI JOIN z USING (doc_id, pos)),
        w AS (SELECT p.*, unnest(range(pos, last + 1)) AS at FROM p),
        i AS (SELECT w.doc_id, w.pos, new, w.why, w.tag, w.confidence, CAST(min(s."end" - length(s.tok)) AS INTEGER) AS start, max(s."end") AS "end",
              string_agg(CASE WHEN s.pos > w.pos THEN gap ELSE '' END || s.tok, '' ORDER BY s.pos) AS o
              FROM w JOIN s ON s.doc_id = w.doc_id AND s.pos = w.at GROUP BY ALL)
        SELECT doc_id, start, "end", o AS original, {case} AS suggestion, why, tag, confidence, 'rule' AS source FROM i"""


def _context() -> str:
    return f"""WITH {_GAPS % _rule_docs()}, {_context_hits()} SELECT doc_id, pos, other, confidence FROM y"""


_WEEK = "CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0')"
_BURST = """b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events)),
    c AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS inputs FROM b GROUP BY user_id, burst)"""
_CLEAN_CUT = r"regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '([.!?])\s+([A-ZÀ-Ỹ])', '\1' || chr(1) || '\2', 'g'), chr(1))"

_STRIPPED = "translate({}, '" + TONED + "', '" + FLATS * 5 + "')"
_LOW_BASES = FLATS[:12]


def _syllables(words: str, name: str) -> str:
    """CTEs: from a table of words (word, in lower case), {name}_p with the parts of each."""
    place = f"""CASE WHEN last = 0 THEN 0 ELSE skip + CASE WHEN before = 0 THEN last WHEN strong > 0 THEN strong WHEN last = length(rest) THEN before ELSE last END END"""
    return f"""{name}_r AS (SELECT word, {_INITIAL} AS initial, {_FINAL} AS final, {_TONE} AS tone, regexp_extract(word, '[{TONED}]') AS mark, low, skip, substr(low, skip + 1) AS rest
            FROM (SELECT *, CASE WHEN regexp_matches(low, '^(qu|gi).*[{_LOW_BASES}]') THEN 2 ELSE 0 END AS skip FROM (SELECT word, lower({_STRIPPED.format('word')}) AS low FROM {words}))),
        {name}_p AS MATERIALIZED (SELECT word, initial, final, tone, CAST(CASE WHEN mark <> '' THEN instr(word, mark) ELSE {place} END AS INTEGER) AS place FROM (
            SELECT *, length(regexp_extract(rest, '^.*[{_LOW_BASES}]')) AS last, length(regexp_extract(rest, '^(.*[{_LOW_BASES}]).*[{_LOW_BASES}]', 1)) AS before,
                   length(regexp_extract(rest, '^[^êơ]*[êơ]')) AS strong FROM {name}_r))"""


def _candidates(words: str, name: str) -> str:
    """CTEs: {name} with word, idx, tag, result, as candidate_rows makes them."""
    letter = _STRIPPED.format("substr(word, place, 1)")
    rows, idx = ["SELECT word, 0 AS idx, 'KEEP' AS tag, word AS result FROM %s_p" % name], 0
    body = "substr(word, length(initial) + 1)"
    single = f"CASE WHEN lower({_STRIPPED.format(f'substr({body}, 1, 1)')}) = 'i' AND length({body}) > 1 THEN substr({body}, 2) ELSE {body} END"
    for tags in (TONE_TAGS, INITIAL_TAGS, FINAL_TAGS):
        for k, tag in enumerate(tags):
            idx += 1
            if tags is TONE_TAGS:
                fits, made = f"tone <> {k}", f"CASE WHEN place = 0 THEN word ELSE substr(word, 1, place - 1) || translate({letter}, '{FLATS}', '{vowels(k)}') || substr(word, place + 1) END"
            elif tags is INITIAL_TAGS:
                fits, made = f"initial = '{tags[tag][0]}'", f"'{tags[tag][1]}' || {single if tags[tag][1] == 'gi' else body}"
            else:
                fits, made = f"final = '{tags[tag][0]}'", f"substr(word, 1, length(word) - length(final)) || '{tags[tag][1]}'"
            rows.append(f"SELECT word, {idx}, '{tag}', {made} FROM {name}_p WHERE {fits} AND {made} <> word")
    return f"{_syllables(words, name)}, {name} AS MATERIALIZED ({' UNION ALL '.join(rows)})"


_LEXICON = "known AS MATERIALIZED (SELECT lower AS word FROM t GROUP BY 1 HAVING count(*) >= {})"
#: The words that are within scope of pairs (wrong, want), by the first tag that leads to a known one.
_SCOPE = "e AS MATERIALIZED (SELECT DISTINCT wrong AS word FROM p), {}, b AS (SELECT word AS wrong, result AS want, arg_min(tag, idx) AS tag FROM k WHERE idx > 0 AND lower(result) IN (SELECT word FROM known) GROUP BY 1, 2)"

_COUNTS = rf"""c0 AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(unnest({_CLEAN_CUT}), '\s+', ' ', 'g')), '[\p{{L}}\p{{M}}]+') AS w FROM documents),
    c AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w, ' ')) AS key, list_transform(w, lambda x: CAST(ceil(length(x) / 3) AS INTEGER)) AS counts FROM c0 WHERE len(w) > 0),
    o AS MATERIALIZED (SELECT doc_id, key, len(counts) AS n, list_prepend(0, list_transform(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]))) AS offs FROM c)"""


def _plan_rows(size: int, stride: int | None) -> str:
    """CTEs with p: run, beg, stop: the windows of each sentence, as they move on."""
    stop = lambda at: f"greatest({at} + 1, len(list_filter(offs, lambda x: x <= offs[{at} + 1] + {size})) - 1)"
    moved = "stop" if stride is None else f"least(stop, greatest(beg + 1, len(list_filter(offs, lambda x: x < offs[beg + 1] + {stride}))))"
    return f"""{_COUNTS}, p AS (SELECT doc_id, key, n, offs, 0 AS run, 0 AS beg, CASE WHEN offs[n + 1] <= 94 THEN n ELSE {stop('0')} END AS stop FROM o
        UNION ALL SELECT doc_id, key, n, offs, run + 1, moved, {stop('moved')} FROM (SELECT *, {moved} AS moved FROM p WHERE stop < n))"""


def _plans(size: int, stride: int | None) -> str:
    return f"WITH RECURSIVE {_plan_rows(size, stride)} SELECT doc_id, key, max(n) AS words, string_agg(beg || ':' || stop, ',' ORDER BY run) AS plan FROM p GROUP BY 1, 2"


_FIXES = """x AS (SELECT word, tag, result AS broken FROM k WHERE idx > 0), y AS (SELECT DISTINCT broken AS word FROM x)"""

ORACLE_SQL: dict[str, str] = {
    "tone_positions": f"WITH {_WORDS}, {_syllables('w', 'k')} SELECT word, place FROM k_p",
    "tag_candidates": f"WITH {_WORDS}, {_candidates('w', 'k')} SELECT CAST(idx AS INTEGER) AS idx, word, tag, result FROM k WHERE idx = 0 OR lower(result) IN (SELECT word FROM w)",
    "tag_between_pairs": f"""WITH {_PAIR}, d AS (SELECT DISTINCT wrong AS src, want AS dst FROM p), e AS (SELECT DISTINCT src AS word FROM d), {_candidates('e', 'k')},
        b AS (SELECT word, result, arg_min(tag, idx) AS tag FROM k WHERE idx > 0 GROUP BY 1, 2)
        SELECT src, dst, CASE WHEN src = dst THEN 'KEEP' ELSE b.tag END AS tag FROM d LEFT JOIN b ON b.word = src AND b.result = dst""",
    "corrupt_options": f"""WITH {_WORDS}, {_LEXICON.format(20)}, {_candidates('w', 'k')}, {_FIXES}, {_candidates('y', 'g')},
        f AS (SELECT word AS broken, result AS word, arg_min(tag, idx) AS fix FROM g WHERE idx > 0 AND lower(result) IN (SELECT word FROM known) GROUP BY 1, 2)
        SELECT x.word, x.tag, x.broken, f.fix FROM x JOIN f ON f.broken = x.broken AND f.word = x.word""",
    "confusable_words": f"""WITH {_WORDS}, {_LEXICON.format(3)}, o AS (SELECT word FROM w WHERE word IN (SELECT word FROM known)), {_candidates('o', 'k')},
        m AS (SELECT DISTINCT word, result AS bad FROM k WHERE idx > 6 AND lower(result) IN (SELECT word FROM known)), y AS (SELECT DISTINCT bad AS word FROM m), {_candidates('y', 'g')},
        f AS (SELECT word AS bad, result AS word, arg_min(tag, idx) AS tag, min(idx) AS idx FROM g WHERE idx > 0 AND lower(result) IN (SELECT word FROM known) GROUP BY 1, 2)
        SELECT word, bad, tag FROM m JOIN f USING (word, bad) WHERE idx > 6""",
    "scope_report": f"""WITH {_PAIR}, {_LEXICON.format(3)}, {_SCOPE.format(_candidates('e', 'k'))}, r AS (
            SELECT b.tag IS NOT NULL AS inside, length(translate(wrong, '{VOWELS}đĐ', '{_PLAIN}dD')) <> length(translate(want, '{VOWELS}đĐ', '{_PLAIN}dD')) AS longer
            FROM p LEFT JOIN b USING (wrong, want) WHERE wrong <> want)
        SELECT count(*) AS errors, count(*) FILTER (inside) AS in_scope, count(*) FILTER (NOT inside AND longer) AS other_length,
        CASE WHEN count(*) > 0 THEN count(*) FILTER (inside) / count(*) ELSE 0.0 END AS ratio FROM r""",
    "scope_by_tag": f"WITH {_PAIR}, {_LEXICON.format(3)}, {_SCOPE.format(_candidates('e', 'k'))} SELECT tag, count(*) AS n FROM p JOIN b USING (wrong, want) WHERE wrong <> want GROUP BY 1",
    "scoped_confusion": f"""WITH {_PRED}, {_LEXICON.format(3)}, {_SCOPE.format(_candidates('e', 'k'))}, r AS (SELECT q.* FROM q LEFT JOIN b USING (wrong, want) WHERE wrong = want OR b.tag IS NOT NULL)
        SELECT count(*) FILTER (wrong <> want AND got = want) AS tp, count(*) FILTER (got <> wrong AND NOT (wrong <> want AND got = want)) AS fp,
        count(*) FILTER (wrong <> want AND got <> want) AS fn FROM r""",
    "run_plan_f1": _plans(40, None),
    "run_plan_f2": _plans(64, 32),
    "run_plan_f2s": _plans(48, 24),
    "run_plan_none": f"WITH {_COUNTS} SELECT doc_id, key, n AS words, '0:' || n AS plan FROM o",
    "centred_pick": f"""WITH RECURSIVE {_plan_rows(64, 32)}, e AS (SELECT *, unnest(range(beg, stop)) AS word FROM p)
        SELECT doc_id || ':' || key AS key, CAST(word AS INTEGER) AS word, CAST(run AS INTEGER) AS run FROM e
        QUALIFY row_number() OVER (PARTITION BY doc_id, key, word ORDER BY least(offs[word + 1] - offs[beg + 1], offs[stop + 1] - offs[word + 2]) DESC, run) = 1""",
    "syllable_lexicon": f"WITH {_TOKENS} SELECT lower AS word, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1 HAVING count(*) >= 20",
    "nfc_normalise": "SELECT doc_id, md5(nfc_normalize(text)) AS plain, md5(nfc_normalize(replace(text, 'é', 'e\u0301'))) AS joined FROM documents",
    "tone_strip": f"WITH {_WORDS} SELECT word, translate(word, '{TONED}', '{FLATS * 5}') AS flat, n FROM w",
    "ascii_fold": f"WITH {_WORDS} SELECT word, translate(word, '{VOWELS}đĐ', '{_PLAIN}dD') AS plain FROM w",
    "tone_detect": f"WITH {_WORDS} SELECT word, CAST(coalesce({_TONE}, -1) AS INTEGER) AS tone FROM w",
    "initial_final_split": f"""WITH {_WORDS}, i AS (SELECT word, {_INITIAL} AS initial, {_FINAL} AS final FROM w)
        SELECT word, initial, substr(word, length(initial) + 1) AS rime, final FROM i""",
    "token_offsets": f'WITH {_GAPS % "documents"} SELECT doc_id, pos, tok, "end" - CAST(length(tok) AS INTEGER) AS start, "end" FROM s',
    "gap_sentences": f"""WITH {_GAPS % "documents"}, n AS (SELECT doc_id, pos, sum(CASE WHEN pos > 0 AND regexp_matches(gap, '[.!?…\\n]') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) AS sent FROM s)
        SELECT doc_id, CAST(sent AS BIGINT) AS sent, min(pos) AS first_pos, count(*) AS n_tokens FROM n GROUP BY doc_id, sent""",
    "sentence_clean": rf"""WITH s AS (SELECT DISTINCT trim(regexp_replace(unnest({_CLEAN_CUT}), '\s+', ' ', 'g')) AS sentence FROM {_rule_docs()}),
        a AS (SELECT sentence, regexp_extract_all(sentence, '[\p{{L}}\p{{M}}]+') AS k FROM s)
        SELECT sentence FROM a WHERE length(sentence) >= 20 AND NOT regexp_matches(sentence, '[<>{{}}\[\]|=\\/@#*_~^]') AND len(k) BETWEEN 4 AND 48
        AND len(list_filter(k, lambda x: regexp_matches(x, '[{TONED}ăâêôơưđĂÂÊÔƠƯĐ]'))) / len(k) >= 0.60
        AND len(list_filter(k, lambda x: length(x) > 7)) / len(k) <= 0.12 AND length(regexp_replace(sentence, '[^0-9]', '', 'g')) / length(sentence) <= 0.08""",
    "dedupe_issues": f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, confidence DESC, source, suggestion) AS k FROM i),
        f AS (SELECT *, true AS kept, "end" AS last FROM o WHERE k = 1
              UNION ALL SELECT o.*, o.start >= f.last, CASE WHEN o.start >= f.last THEN o."end" ELSE f.last END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
        SELECT doc_id, start, "end", confidence, source, suggestion FROM f WHERE kept""",
    "merge_rule_first": f"""WITH {_SPANS} SELECT * FROM i WHERE source = 'rule' UNION ALL
        SELECT * FROM i WHERE source = 'model' AND NOT EXISTS (SELECT 1 FROM i r WHERE r.source = 'rule' AND r.doc_id = i.doc_id AND i.start < r."end" AND r.start < i."end")""",
    "interval_hit": f"""WITH {_SPANS}, r AS (SELECT doc_id, k * 200 AS begin_, k * 200 + 100 AS stop FROM (SELECT doc_id, unnest(range(max(start) // 200 + 1)) AS k FROM i GROUP BY 1))
        SELECT CAST(coalesce(r.begin_, -1) AS INTEGER) AS "begin", count(*) AS n, count(DISTINCT i.doc_id) AS docs
        FROM i LEFT JOIN r ON i.doc_id = r.doc_id AND r.begin_ <= i.start AND i.start < r.stop GROUP BY 1""",
    "html_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
            '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<code\b.*?</code\s*>|<pre\b.*?</pre\s*>', '', 'g'),
            '(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM pages""",
    "hash_split": f"""SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) < 128 THEN 'mine' ELSE 'eval' END AS half,
        CASE WHEN u < 0.90 THEN 'train' WHEN u < 0.95 THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT doc_id, coalesce(text, '') AS text, {_u(7, "coalesce(text, '')")} AS u FROM documents)""",
    "class_weights": f"""WITH {_PAIR}, c AS (SELECT substr(want, 1, 1) AS class, count(*) AS n FROM p WHERE wrong <> want GROUP BY 1)
        SELECT class, n, round(n / sum(n) OVER (), 4) AS weight FROM c""",
    "propensity": f"""WITH {_PAIR}, c AS (SELECT want AS word, count(*) AS n, count(*) FILTER (want <> wrong) AS errors FROM p GROUP BY 1),
        b AS (SELECT sum(errors) / sum(n) AS base FROM c)
        SELECT word, n, errors, round(least(greatest((errors + 3 * base) / (n + 3) / base, 0.2), 20.0), 6) AS factor FROM c, b WHERE base > 0""",
    "oov_rate": f"""WITH {_WORDS} SELECT doc_id, count(*) AS unknown FROM t JOIN w ON t.lower = w.word WHERE n < 20 GROUP BY 1""",
    "softmax_gate": f"""WITH {_LOGITS} SELECT doc_id, pos, best, round(best_p, 6) AS best_p, round(keep_p, 6) AS keep_p,
        CASE WHEN best_p >= CASE WHEN best = 'TONE_HOI' THEN 0.5 ELSE 0.45 END AND best_p - keep_p >= 0.25 THEN best ELSE 'KEEP' END AS decision FROM g""",
    "gate_argmax": f"""WITH {_LOGITS} SELECT CASE WHEN z0 >= greatest(z1, z2, z3) THEN 'KEEP' WHEN z1 >= greatest(z2, z3) THEN 'TONE_HOI' WHEN z2 >= z3 THEN 'CH_TR' ELSE 'N_NG' END AS decision,
        count(*) AS n FROM g GROUP BY 1""",
    "policy_sweep": f"""WITH {_LOGITS} SELECT 'P0' AS policy, count(*) AS n, count(*) FILTER (best_p >= 0.95 AND best_p - keep_p >= 0.25) AS fires FROM g
        UNION ALL SELECT 'P1', count(*), count(*) FILTER (best_p / (1 - keep_p) >= 0.9) FROM g
        UNION ALL SELECT 'T80', count(*), count(*) FILTER (best_p >= 0.8 AND best_p - keep_p >= 0) FROM g""",
    "confusion_full": f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (wrong <> want AND got = want) AS tp,
        count(*) FILTER (got <> wrong AND NOT (wrong <> want AND got = want)) AS fp, count(*) FILTER (wrong <> want AND got <> want) AS fn FROM q),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
        SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM r""",
    "confusion_scoped": f"""WITH {_PRED} SELECT count(*) FILTER (wrong <> want AND got = want) AS tp,
        count(*) FILTER (got <> wrong AND NOT (wrong <> want AND got = want)) AS fp, count(*) FILTER (wrong <> want AND got <> want) AS fn
        FROM q WHERE wrong = want OR substr(wrong, 1, 1) = substr(want, 1, 1)""",
    "outcome_pivot": f"""WITH {_PRED}, o AS (SELECT substr(want, 1, 1) AS letter, {_OUTCOME} AS outcome FROM q)
        SELECT letter, {', '.join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ('fixed', 'missed', 'wrong_fix', 'false_alarm', 'clean'))} FROM o GROUP BY ROLLUP (letter)""",
    "sentence_buckets": f"""WITH {_PRED}, o AS (SELECT doc_id, wrong <> want AS error, substr(wrong, 1, 1) = substr(want, 1, 1) AS inside, {_OUTCOME} AS k FROM q),
        d AS (SELECT doc_id, count(*) FILTER (error) AS errors, count(*) FILTER (error AND inside) AS i, count(*) FILTER (k = 'fixed') AS f, count(*) FILTER (k = 'missed') AS m,
              count(*) FILTER (k IN ('wrong_fix', 'false_alarm')) AS x FROM o GROUP BY 1)
        SELECT least(errors, 4) AS errors, CASE WHEN x > 0 THEN 'wrong_edit' WHEN m = 0 THEN 'clean' WHEN i > 0 AND f = i THEN 'scope_fixed' WHEN f > 0 THEN 'partly' ELSE 'untouched' END AS bucket, count(*) AS n
        FROM d WHERE errors > 0 GROUP BY 1, 2""",
    "false_alarm_report": f"""WITH {_PRED}, s AS (SELECT source, q.doc_id, count(*) AS words, count(*) FILTER (got <> wrong) AS alarms
        FROM q JOIN documents USING (doc_id) WHERE wrong = want GROUP BY 1, 2)
        SELECT source, count(*) AS sentences, CAST(sum(words) AS BIGINT) AS words, CAST(sum(alarms) AS BIGINT) AS alarms,
        count(*) FILTER (alarms > 0) AS hit_sentences, count(*) FILTER (alarms > 0) / count(*) AS hit_share FROM s GROUP BY 1""",
    "paired_discordance": f"""WITH {_PRED}{_got('q2', 10)}, a AS (SELECT doc_id, pos, got FROM q WHERE got <> wrong), b AS (SELECT doc_id, pos, got FROM q2 WHERE got <> wrong),
        c AS (SELECT count(*) AS n, count(*) FILTER (a.got = b.got) AS same, count(*) FILTER (a.got <> b.got) AS changed,
              count(*) FILTER (b.got IS NULL) AS only_a, count(*) FILTER (a.got IS NULL) AS only_b FROM a FULL JOIN b USING (doc_id, pos))
        SELECT *, only_b - only_a AS delta, round(sqrt(only_a + only_b) / n, 9) AS se FROM c""",
    "latency_quantiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75,
        round(quantile_cont(value, 0.9), 6) AS p90, round(max(value) FILTER (i = least(n - 1, floor(n * 0.5))), 6) AS p50,
        round(max(value) FILTER (i = least(n - 1, floor(n * 0.95))), 6) AS p95, round(max(value) FILTER (i = least(n - 1, floor(n * 0.99))), 6) AS p99 FROM r GROUP BY 1""",
    "index_quantiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, "
    + ", ".join(f"max(value) FILTER (i = floor(n * {q}) - 1) AS before_{round(100 * q)}, max(value) FILTER (i = ceil(n * {q}) - 1) AS ceil_{round(100 * q)}" for q in (0.5, 0.9, 0.95))
    + " FROM r GROUP BY 1",
    "balanced_cases": f"""WITH {_PAIR}, c AS (SELECT substr(want, 1, 1) AS tag, want AS word, doc_id, pos FROM p WHERE wrong <> want),
        h AS (SELECT *, {_u(5, 'tag', 'word', 'doc_id', 'pos')} AS u FROM c),
        k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY tag, lower(word) ORDER BY u, doc_id, pos) <= 3)
        SELECT tag, word, doc_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY tag ORDER BY u, doc_id, pos) <= 120""",
    "mix_report": f"""WITH {_PRED} SELECT source, count(*) AS tokens, count(*) FILTER (wrong <> want) AS errors FROM q JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""",
    "top_tags": f"""WITH {_TOKENS}, c AS (SELECT substr(lower, 1, 2) AS tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 10)
        SELECT tag, n, round(n / max(n) OVER (), 6) AS bar FROM c""",
    "weekly_tag_counts": f"""WITH c AS (SELECT {_WEEK} AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT * FROM c WHERE week IN (SELECT DISTINCT week FROM c ORDER BY week DESC LIMIT 8)""",
    "debounce_latest": f"WITH {_BURST} SELECT user_id, first_ts, last_ts, last_id, inputs FROM c",
    "burst_metrics": f"WITH {_BURST} SELECT user_id, count(*) AS bursts, max(inputs) AS most, CAST(sum(inputs) AS BIGINT) AS inputs FROM c GROUP BY 1",
    "latest_wins": """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "change_only": """SELECT conv_id, turn FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b IS DISTINCT FROM text""",
    "acceptance_ratio": f"""SELECT {_WEEK} AS week, count(*) AS shown, count(*) FILTER (event_type = 'purchase') AS accepted,
        round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS ratio FROM events GROUP BY 1""",
}


def complete() -> dict[str, str]:
    return ORACLE_SQL | {"phrase_match": _phrases(), "context_issues": _context(), "check_text": _check_text()}
