"""Byte-level BPE encoding with a word cache.

A byte-level BPE never merges across its pre-token pattern's boundaries, and a single
space between two non-space characters always starts a new pre-token.  So a text may be
cut there, each distinct cut encoded once by the tokenizers library, and the ids joined:
the result equals encoding the whole text, at a fraction of the cost, as most words
of a corpus have been seen before.  The tokenizer is used as the file has it; a text that holds one of its
added tokens (<|endoftext|>) is encoded in one go, as these are found before all else.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np

#: Distinct words kept per Python worker in each of two generations of the cache, if the caller gives no number: some 30 MB each
#: at most.  More words are faster and take memory in proportion; the ids are the same.
CACHE_WORDS = 200_000
#: Distinct runs of marks behind words, likewise.
CACHE_TAILS = 20_000
#: Longer words are not kept.
CACHE_CHARS = 64

#: ASCII marks that may end a word; the apostrophe may begin a pre-token of its own and is left out.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What is not plain ASCII, Latin, Greek or Cyrillic: other libraries may class it otherwise.
_ODD = re.compile("[^\t\n\r -~\xa1-\u052f]")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def default_vocabulary() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, cache_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN).findall
        self.cache_words = cache_words or CACHE_WORDS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        """Ids of the text encoded in one go."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, pre_tokens: list[str]) -> bytes:
        """Ids of pre-tokens in the byte-level alphabet, from the model alone."""
        ids = [t.id for p in pre_tokens for t in self.model.tokenize(p)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a space-led word: mostly letters and then marks, which are a pre-token each."""
        if _ODD.search(word):
            return self.plain(" " + word)
        letters = word.rstrip(_MARKS)
        if not letters.isalpha():
            return self._ids([p.encode().decode("latin-1").translate(_BYTE_LEVEL) for p in self.pre_tokens(" " + word)])
        if len(letters) == len(word):
            plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_LEVEL)
            return self._ids(["Ġ" + plain])
        ids = self.young.get(letters) or self._missing(letters)
        marks = word[len(letters) :]
        if (tail := self.tails.get(marks)) is None:
            if len(self.tails) > CACHE_TAILS:
                self.tails.clear()
            self.tails[marks] = tail = self._ids([marks])
        return ids + tail

    def _missing(self, word: str) -> bytes | None:
        """Ids of a space-led word that the young generation lacks; None where the cut before it was not safe."""
        ids = self.old.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            ids = self._word(word)
            if len(word) > CACHE_CHARS:
                return ids
        if len(self.young) >= self.cache_words:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null and empty give no ids."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.plain(text)
        head, *words = text.split(" ")
        if words and (not head or head[-1].isspace()):
            return self._loose(text)
        ids = list(map(self.young.get, words))
        at, old = -1, self.old
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            word = words[at]
            known = old.get(word)
            if known is None or len(self.young) >= self.cache_words:
                known, old = self._missing(word), self.old
                if known is None:
                    return self._loose(text)
            else:
                self.young[word] = known
            ids[at] = known
        return self._head(head) + b"".join(ids)

    def _head(self, word: str) -> bytes:
        """Ids of a text's first word, which no space leads."""
        ids = self.heads.get(word)
        if ids is None:
            ids = self.plain(word)
            if len(word) <= CACHE_CHARS:
                if len(self.heads) >= CACHE_TAILS:
                    self.heads.clear()
                self.heads[word] = ids
        return ids

    def _loose(self, text: str) -> bytes:
        """Ids of a text with runs of white space: it is cut only where it is safe."""
        head, *words = _CUT.split(text)
        return self.plain(head) + b"".join([self._inner(w) for w in words])

    def _inner(self, word: str) -> bytes:
        if (known := self.young.get(word)) is not None:
            return known
        ids = None if " " in word else self._missing(word)
        return self.plain(" " + word) if ids is None else ids


@functools.cache
def encoder(path: str, cache_words: int | None = None) -> CachedEncoder:
    """One encoder per Python worker, vocabulary and size of cache."""
    return CachedEncoder(path, cache_words)


def crc32(ids: bytes) -> int:
    """Unsigned crc32 of little-endian unsigned 32-bit ids."""
    return zlib.crc32(ids)
