"""Taking syllables apart and putting them together again, as Spark expressions.

All functions take and return columns, so that everything stays in the JVM; over texts, apply them to the
distinct syllables and join the results back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.functions.alphabet import FINAL_TAGS, FINALS, FLATS, INITIAL_TAGS, INITIALS, TONE_TAGS, TONED, VOWELS, strip_tone, vowels


def tone_position(s: Column) -> Column:
    """Place from 1 of the vowel that bears the tone; 0 if there is no vowel.

    The glide of qu and gi does not count if another vowel follows.  ê and ơ come first; else, if a consonant ends the
    syllable, its last vowel, otherwise the last but one.
    """
    vowel = f"[{FLATS[:12]}]"
    low = F.lower(strip_tone(s))
    skip = F.when(low.rlike(f"^(qu|gi).*{vowel}"), 2).otherwise(0)
    rest = F.substr(low, skip + 1)
    last = F.length(F.regexp_extract(rest, f"(?s)^.*{vowel}", 0))
    before = F.length(F.regexp_extract(rest, f"(?s)^(.*{vowel}).*{vowel}", 1))
    strong = F.regexp_instr(rest, F.lit("[êơ]"))
    place = F.when(before == 0, last).when(strong > 0, strong).when(last == F.length(rest), before).otherwise(last)
    return F.when(last == 0, 0).otherwise(skip + place)


def tone(s: Column) -> Column:
    """The tone, 0 to 5, of the first vowel with a mark; 0 if none has one, null without vowels."""
    mark = F.regexp_extract(s, f"[{TONED}]", 0)
    which = F.floor((F.instr(F.lit(TONED), mark) - 1) / len(FLATS)) + 1
    return F.when(mark != "", which).when(s.rlike(f"[{VOWELS}]"), F.lit(0)).cast("int")


def tone_place(s: Column) -> Column:
    """Place from 1 of the marked vowel, else where a mark would go; 0 without vowels."""
    mark = F.regexp_extract(s, f"[{TONED}]", 0)
    return F.when(mark != "", F.instr(s, mark)).otherwise(tone_position(s)).cast("int")


def set_tone(s: Column, to: int, at: Column | None = None) -> Column:
    """The syllable with the tone, on the vowel that has it or should have it; cases stay.  at: its tone_place, if known."""
    at = tone_place(s) if at is None else at
    letter = F.translate(strip_tone(F.substr(s, at, F.lit(1))), FLATS, vowels(to))
    return F.when(at == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), letter, F.substr(s, at + 1)))


def initial(s: Column) -> Column:
    """The initial consonants, as written; the longest known ones; gi and qu only before another vowel."""
    plain = [i for i in INITIALS if i not in ("gi", "qu")]
    glides = F.regexp_extract(s, f"(?iu)^(gi|qu)(?=.*[{VOWELS}])", 1)
    return F.when(glides != "", glides).otherwise(F.regexp_extract(s, f"(?iu)^({'|'.join(plain)})", 1))


def rime(s: Column) -> Column:
    return F.substr(s, F.length(initial(s)) + 1)


def final(s: Column) -> Column:
    """The final consonants in lower case, or nothing."""
    return F.regexp_extract(F.lower(s), f"({'|'.join(FINALS)})$", 1)


def set_final(s: Column, new: str, old: Column | None = None) -> Column:
    """The syllable with another final, which is written as given.  old: its final, if known."""
    return F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(final(s) if old is None else old)), F.lit(new))


def match_case(sample: Column, new: Column) -> Column:
    """new in the case of sample: a sample all in capitals, even of one letter, gives capitals."""
    shout = (sample == F.upper(sample)) & (sample != F.lower(sample))
    head = F.substr(sample, F.lit(1), F.lit(1))
    title = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2)))
    return F.when(F.length(sample) == 0, new).when(shout, F.upper(new)).when(head != F.lower(head), title).otherwise(new)


def set_initial(s: Column, new: str, old: Column | None = None) -> Column:
    """The syllable with another initial; c/k, g/gh and ng/ngh as the vowel wants them, gi without a second i.

    old: its initial, if known.
    """
    old = initial(s) if old is None else old
    body = F.substr(s, F.length(old) + 1)
    vowel = F.lower(strip_tone(F.regexp_extract(body, f"[{VOWELS}]", 0)))
    front = vowel.isin("e", "ê", "i", "y")
    spelt = F.lit(new)
    for pair in (("c", "k"), ("g", "gh"), ("ng", "ngh")):
        if new in pair:
            spelt = F.when(front, pair[1]).otherwise(pair[0])
    if new == "gi":
        double = F.lower(strip_tone(F.substr(body, F.lit(1), F.lit(1)))) == "i"
        body = F.when(double & (F.length(body) > 1), F.substr(body, F.lit(2))).otherwise(body)
    return F.concat(match_case(F.when(old == "", s).otherwise(old), spelt), body)


def apply_tag(tag: str, s: Column) -> Column:
    """The syllable after a transformation tag."""
    if tag in TONE_TAGS:
        return set_tone(s, TONE_TAGS.index(tag))
    if tag in INITIAL_TAGS:
        return set_initial(s, INITIAL_TAGS[tag][1])
    return set_final(s, FINAL_TAGS[tag][1]) if tag in FINAL_TAGS else s


def candidate_rows(words: DataFrame) -> DataFrame:
    """word -> word, idx, tag, result: the tags that fit the syllable and change it, numbered in tag order; KEEP always."""
    return candidates(words).select("word", F.inline("_candidates")).where("idx = 0 or result <> word")


def candidates(words: DataFrame, *more: str) -> DataFrame:
    """word and more with _candidates: idx, tag, result of all tags in their order, the result null where a tag does not fit.

    Tone, place, initial and final are generated as columns first: the optimizer does not merge projections across that, so
    each is computed once for a word.
    """
    s = F.col("word")
    parts = F.struct(tone(s).alias("_tone"), tone_place(s).alias("_place"), initial(s).alias("_initial"), final(s).alias("_final"))
    known = words.select("word", *more, F.inline(F.array(parts)))
    out, idx = [F.struct(F.lit(0).alias("idx"), F.lit("KEEP").alias("tag"), s.alias("result"))], 0
    for table in (TONE_TAGS, INITIAL_TAGS, FINAL_TAGS):
        for k, tag in enumerate(table):
            idx += 1
            if table is TONE_TAGS:
                fits, changed = F.col("_tone") != k, set_tone(s, k, F.col("_place"))
            elif table is INITIAL_TAGS:
                fits, changed = F.lower("_initial") == table[tag][0], set_initial(s, table[tag][1], F.col("_initial"))
            else:
                fits, changed = F.col("_final") == table[tag][0], set_final(s, table[tag][1], F.col("_final"))
            out.append(F.struct(F.lit(idx).alias("idx"), F.lit(tag).alias("tag"), F.when(fits, changed).alias("result")))
    return known.select("word", *more, F.array(*out).alias("_candidates"))
