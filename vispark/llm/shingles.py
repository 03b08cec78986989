"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that are hashed at a time; a longer text goes in several blocks, cut between words.
BLOCK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_ODD = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _ODD[60]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[61]
    x = (x ^ (x >> np.uint64(29))) * _ODD[62]
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for i, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _block_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One hash a word, in order; words are runs without white space, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(data) <= BLOCK:
        return _block_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; of a shorter text, of all its words; of none, nothing."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < size:
        whole = np.concatenate([words * _ODD[:n], _ODD[50 : 50 + n]])
        return _mix(whole.sum(dtype=np.uint64, keepdims=True))
    total = words[: n - size + 1] * _ODD[0]
    for j in range(1, size):
        total = total + words[j : n - size + 1 + j] * _ODD[j]
    return np.unique(_mix(total))


def digest(data: bytes) -> bytes:
    """A 128-bit name of data."""
    return hashlib.blake2b(data, digest_size=16).digest()
