"""Vowels, tones and transformation tags of Vietnamese syllables, as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowel bases in order; a tone is a combining mark on one of them.
BASES = "aăâeêioôơuưy"
#: Combining marks of the tones 0 to 5: none, grave, acute, hook, tilde, dot below.
MARKS = ("", "̀", "́", "̉", "̃", "̣")
FLAT, GRAVE, ACUTE, HOOK, TILDE, DOT = range(6)

#: Tags in their order, each with the initial or final that it sets and the one it applies to.
TONE_TAGS = ("TONE_NGANG", "TONE_HUYEN", "TONE_SAC", "TONE_HOI", "TONE_NGA", "TONE_NANG")
INITIAL_TAGS = {
    "L_N": ("l", "n"), "N_L": ("n", "l"), "CH_TR": ("ch", "tr"), "TR_CH": ("tr", "ch"), "S_X": ("s", "x"), "X_S": ("x", "s"),
    "D_GI": ("d", "gi"), "GI_D": ("gi", "d"), "D_R": ("d", "r"), "R_D": ("r", "d"), "GI_R": ("gi", "r"), "R_GI": ("r", "gi"),
}
FINAL_TAGS = {"N_NG": ("n", "ng"), "NG_N": ("ng", "n"), "C_T": ("c", "t"), "T_C": ("t", "c")}
TAGS = ("KEEP", *TONE_TAGS, *INITIAL_TAGS, *FINAL_TAGS)
INITIALS = (
    "ngh", "ng", "nh", "ch", "gh", "gi", "kh", "ph", "th", "tr", "qu", "b", "c", "d", "đ", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "x",
)
FINALS = ("nh", "ng", "ch", "c", "m", "n", "p", "t")


def vowels(tone: int) -> str:
    """All bases in both cases under a tone, in order."""
    return "".join(unicodedata.normalize("NFC", b + MARKS[tone]) for b in BASES + BASES.upper())


FLATS = vowels(FLAT)
TONED = "".join(vowels(t) for t in range(1, 6))
VOWELS = FLATS + TONED


def strip_tone(s: Column) -> Column:
    """The syllable without its tone; the vowels keep their quality."""
    return F.translate(s, TONED, FLATS * 5)


def to_ascii(s: Column) -> Column:
    """Plain letters: no tone, no vowel quality, d for đ."""
    plain = "".join(unicodedata.normalize("NFD", c)[0] for c in VOWELS)
    return F.translate(s, VOWELS + "đĐ", plain + "dD")
