"""License notices, found exactly and with a few edits.

Texts are lower-cased (A-Z) and taken as words.  Phrases are looked up word by word.  Notices are searched for
with a bounded number of edits, over the words joined by single blanks: a notice that may have k edits
is split into k + 2 pieces, of which two at least must then occur unchanged and about as far from each other as in the
notice.  An Aho-Corasick automaton finds all pieces in one pass; only where two of them agree does
the regex library verify, by bounded-error matching, and give the span and its edits.  A notice's telling words must be unchanged
within the match: an edit must not turn one licence into another.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vispark.llm.common import whole_text

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label, notice, and the words that alone tell it from notices of other licences: these must stand as they are.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mit", "released under the mit license", "mit"),
    ("mit", "licensed under the mit license", "mit"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license", ""),
    ("gpl", "licensed under the gnu general public license version", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify", ""),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser"),
    ("agpl", "under the terms of the gnu affero general public license", "affero"),
    ("gpl", "under the terms of the gnu general public license", "gnu general"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("cc-by", "licensed under a creative commons attribution license", "attribution license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
)
#: A notice may have one edit for so many characters.
CHARS_PER_EDIT = 12

#: Everything but 0-9, a-z and bytes from 80 on becomes a blank; A-Z become a-z.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(_SPAN)),
    ]
)
_ROW_SQL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long, edits: int>>"
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 2 pieces that make up the notice."""
    n = edits + 2
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Finds all notices in a text of words joined by single blanks."""

    def __init__(self, notices: tuple[tuple[str, str, str], ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [(label, text, len(text) // CHARS_PER_EDIT) for label, text, _ in notices]
        self.telling = [f" {words} " if words else "" for *_, words in notices]
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(t)}){{e<={k}}}") for _, t, k in self.notices]
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                owners.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.seeds.add_word(piece, (len(piece), own))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in characters of text, ordered; of overlapping notices the one with the fewest edits.

        Edits may fall anywhere but into a notice's telling words.
        """
        begins: dict[int, list[int]] = {}
        for end, (n, own) in self.seeds.iter(text):
            for i, at in own:
                begins.setdefault(i, []).append(end + 1 - n - at)
        found = set()
        for i, places in begins.items():
            label, notice, k = self.notices[i]
            places.sort()
            done = -1
            for a, b in zip(places, places[1:]):
                if b - a > k or a + k <= done:  # two unchanged pieces of one match lie on diagonals at most k apart
                    continue
                low = max(0, a - k)
                match = self.verify[i].search(text, low, min(len(text), b + len(notice) + k))
                if match:
                    if self.telling[i] in f" {match[0]} ":
                        found.add((match.start(), match.end(), label, sum(match.fuzzy_counts)))
                    done = match.end() - len(notice) + k
        kept: list[tuple[int, int, str, int]] = []
        for hit in sorted(found, key=lambda h: (h[3], h[0] - h[1], h)):
            at = bisect.bisect(kept, hit)
            if (not at or kept[at - 1][1] <= hit[0]) and (at == len(kept) or hit[1] <= kept[at][0]):
                kept.insert(at, hit)
        return kept


@functools.cache
def _search() -> NoticeSearch:
    return NoticeSearch()


def scan_text(text: str) -> tuple:
    """A row of _ROW without doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    base: list[tuple[int, str]] = []
    for phrase, label in PHRASES.items():
        if phrase in joined:
            want = phrase.encode().split()
            base += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    spans = _search().find(joined)
    shown = []
    if spans:
        places, at = [], 0  # where each word stands in the text, in code points
        for w in (w.decode("utf-8", "surrogatepass") for w in words):
            at = _lower(text).index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        for a, b, label, edits in spans:
            first, last = joined.count(" ", 0, a), joined.count(" ", 0, max(a, b - 1))
            shown.append({"label": label, "start": places[first][0], "end": places[last][1], "edits": edits})
    by_label = {label for _, label in base}
    score = max([1.0] * bool(base) + [1 - e / max(1, b - a) for a, b, _, e in spans], default=0.0)
    starts = [i for i, _ in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(by_label)),
        ",".join(sorted(by_label | {label for _, _, label, _ in spans})),
        max(0.0, score),
        shown,
    )


@functools.lru_cache(1)
def _lower(text: str) -> str:
    return text.translate({b: b + 32 for b in range(0x41, 0x5B)})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of all phrases; first_word and last_word are their smallest and largest start (null: none).
    labels adds those of notices with edits; spans has each such notice's label, code-point span and edits.  score is 1 for an
    exact phrase, else the best share of a notice that is unchanged, else 0.  Null text counts as empty and gives
    zeros and empty lists; other columns are ignored; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *scan_text(t.as_py())) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = zip(*rows) if rows else [[]] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(scan, _ROW_SQL)
