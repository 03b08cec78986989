"""Groups of transformation tags, for display, diagnosis and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vispark.functions.alphabet import FLAT, HOOK, TILDE, TONE_TAGS
from vispark.functions.syllable import tone

# Groups of tags that are no tones.  Display has no group of its own for l and n.
DISPLAY = {
    "ch-tr": ("CH_TR", "TR_CH"), "s-x": ("S_X", "X_S"), "d-gi-r": ("D_GI", "GI_D", "D_R", "R_D", "GI_R", "R_GI"), "n-ng": ("N_NG", "NG_N", "C_T", "T_C"),
}
DISPLAY_REST = "chinh-ta"
DIAGNOSIS = {"phu_am_dau": ("L_N", "N_L", "CH_TR", "TR_CH", "S_X", "X_S"), "d_gi_r": ("D_GI", "GI_D", "D_R", "R_D", "GI_R", "R_GI")}
DIAGNOSIS_REST = "am_cuoi"
CONSONANTS = {
    "l/n": ("L_N", "N_L"), "ch/tr": ("CH_TR", "TR_CH"), "s/x": ("S_X", "X_S"), "d/gi/r": ("D_GI", "GI_D", "D_R", "R_D", "GI_R", "R_GI"),
    "n/ng": ("N_NG", "NG_N"), "c/t": ("C_T", "T_C"),
}
SEVERE = 0.9


def _among(tag: Column, groups: dict[str, tuple[str, ...]], rest: str | None) -> Column:
    out = None
    for name, tags in groups.items():
        out = F.when(tag.isin(*tags), name) if out is None else out.when(tag.isin(*tags), name)
    return out.otherwise(rest) if rest is not None else out


def _both_hook_or_tilde(a: Column, b: Column) -> Column:
    return F.coalesce(tone(a).isin(HOOK, TILDE) & tone(b).isin(HOOK, TILDE), F.lit(False))


def display_group(tag: Column, wrong: Column, right: Column) -> Column:
    """The group that a user sees.  A tone's depends on both syllables: hook and tilde, no mark where one is due, or another mark."""
    missing = tone(wrong).eqNullSafe(F.lit(FLAT)) & ~tone(right).eqNullSafe(F.lit(FLAT))
    tones = F.when(_both_hook_or_tilde(wrong, right), "hoi-nga").when(missing, "thieu-dau").otherwise("sai-dau")
    return F.when(tag.isin(*TONE_TAGS), tones).otherwise(_among(tag, DISPLAY, DISPLAY_REST))


def diagnosis_group(tag: Column, wrong: Column, right: Column) -> Column:
    """The group of a diagnosis table; here every flat syllable counts as one whose mark is missing."""
    tones = F.when(_both_hook_or_tilde(wrong, right), "hoi_nga").when(tone(wrong).eqNullSafe(F.lit(FLAT)), "mat_dau").otherwise("sai_dau")
    return F.when(tag.isin(*TONE_TAGS), tones).otherwise(_among(tag, DIAGNOSIS, DIAGNOSIS_REST))


def consonant_group(tag: Column) -> Column:
    """The pair of consonants that a tag is about; null for tones and KEEP."""
    return _among(tag, CONSONANTS, None)


def severity(confidence: Column) -> Column:
    """high from 0.9 on, else low."""
    return F.when(confidence >= SEVERE, "high").otherwise("low")
