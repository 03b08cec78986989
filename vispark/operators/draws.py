"""Errors of sentences drawn over arrays: what corpus.corrupt does with a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _four(x: np.ndarray, value) -> np.ndarray:
    return _turned(x ^ (value * _P1), 23) * _P2 + _P3


def _eight(x: np.ndarray, value) -> np.ndarray:
    return _turned(x ^ (_turned(value * _P2, 31) * _P1), 27) * _P1 + _P4


def with_int(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """F.xxhash64 of one key more, an int: state is what it gave for the keys before."""
    return _mixed(_four(state + _P5 + np.uint64(4), value.astype(np.int32).view(np.uint32).astype(np.uint64)))


def with_long(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mixed(_eight(state + _P5 + np.uint64(8), value.astype(np.int64).view(np.uint64)))


def with_name(state: np.ndarray, name: str) -> np.ndarray:
    """The same for a short string."""
    raw = name.encode()
    if len(raw) >= 32:
        raise ValueError(f"a class needs a shorter name: {name}")
    x, at = state + _P5 + np.uint64(len(raw)), 0
    while at + 8 <= len(raw):
        x, at = _eight(x, np.frombuffer(raw, "<u8", 1, at)), at + 8
    if at + 4 <= len(raw):
        x, at = _four(x, np.frombuffer(raw, "<u4", 1, at).astype(np.uint64)), at + 4
    for byte in raw[at:]:
        x = _turned(x ^ (np.full(1, byte, np.uint64) * _P5), 11) * _P1
    return _mixed(x)


def unit(state: np.ndarray) -> np.ndarray:
    """As corpus.draw: a number in (0, 1)."""
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) / float(2**53)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many elements: each element's run, and its place within the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a value begins, of equal ones side by side."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


class Options:
    """The options of some words: for each word those of a class side by side, with the number that an option has within its word."""

    def __init__(self, table: pa.Table, weights: dict[str, float]):
        self.words = table.column("word").combine_chunks()
        lists = table.column("opts").combine_chunks()
        self.broken, self.fix, names = lists.flatten().flatten()
        self.factor = table.column("factor").to_numpy()
        order = sorted(weights)  # of equal draws the first by name
        kind = pc.index_in(names, pa.array(order, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        word, number = _spread(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = np.flatnonzero((kind >= 0) & (np.array([*(weights[n] for n in order), 0.0])[kind] > 0))
        at = at[np.lexsort((number[at], kind[at], word[at]))]
        self.at, self.kind, self.number = at, kind[at], number[at]
        self.count = np.bincount(word[at], minlength=len(self.words))
        self.begin = np.cumsum(self.count) - self.count


def drawn(options: Options, weights: dict[str, float], most: int, word: np.ndarray, sentence: np.ndarray, pos: np.ndarray, hit: np.ndarray, state: np.ndarray, by_class: np.ndarray):
    """Tokens and the options that break them.

    For each token: its word among the options' (-1: none), the number of its sentence from 0 upwards, its place, whether its hash is under the
    rate, and the hash of the keys before its place.  by_class: for each sentence the hash of the keys before the round.
    """
    names = sorted(weights)
    n = np.minimum(np.bincount(sentence, weights=hit & (word >= 0), minlength=len(by_class)).astype(np.int64), most)
    token = np.flatnonzero((word >= 0) & (n[sentence] > 0))
    token = token[options.count[word[token]] > 0]
    run, place = _spread(options.count[word[token]])
    option = options.begin[word[token]][run] + place
    key = -np.log(unit(with_int(with_int(state[token], pos[token])[run], options.number[option]))) / options.factor[word[token]][run]
    # A token breaks once, and an option's key is the same in each round: of each class of a token only its first can be drawn.
    group = run * len(names) + options.kind[option]
    heads = _heads(group)
    least = np.minimum.reduceat(key, heads) if len(heads) else key
    size = np.diff(np.append(heads, len(key)))
    first = np.flatnonzero(key == np.repeat(least, size))
    first = first[_heads(group[first])]
    token, option, key = token[run[first]], option[first], key[first]
    pool = sentence[token] * len(names) + options.kind[option]
    order = np.lexsort((pos[token], key, pool))
    token, option, pool = token[order], option[order], pool[order]
    taken = np.zeros(len(word), bool)
    got_token, got_option = [], []
    for k in range(1, most + 1):
        left = ~taken[token] & (n[pool // len(names)] >= k)
        token, option, pool = token[left], option[left], pool[left]
        if not len(token):
            break
        best = _heads(pool)
        of, kind = pool[best] // len(names), pool[best] % len(names)
        before, draw = with_int(by_class[of], np.full(len(of), k)), np.empty(len(of))
        for c in np.unique(kind):
            some = kind == c
            draw[some] = -np.log(unit(with_name(before[some], names[c]))) / weights[names[c]]
        order = np.lexsort((kind, draw, of))
        chosen = best[order[_heads(of[order])]]
        taken[token[chosen]] = True
        got_token.append(token[chosen])
        got_option.append(option[chosen])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *got_token]), options.at[np.concatenate([none, *got_option])]


def broken_batches(batches: Iterator[pa.RecordBatch], weights: dict[str, float], most: int, cumulative: bool) -> Iterator[pa.RecordBatch]:
    """Rows by chunk, in each first those of words (chunk, word, opts, factor), then those of texts -> doc_id, pos, toks, tags of the texts.

    cumulative: sents tells where a sentence begins, and places count from 0; else sents and pos have the numbers themselves.
    """
    held: list[pa.Table] = []
    options, options_of = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        chunks = table.column("chunk").to_numpy()
        for begin, end in zip(_heads(chunks), [*_heads(chunks)[1:], len(chunks)]):
            some, chunk = table.slice(begin, end - begin), chunks[begin]
            if options_of != chunk:
                held, options, options_of = [], None, chunk
            named = some.filter(pc.is_valid(some.column("word")))
            texts = some.filter(pc.is_null(some.column("word")))
            held.append(named.select(["word", "opts", "factor"]))
            if texts.num_rows:
                if options is None:
                    options = Options(pa.concat_tables(held), weights)
                    held = []
                for at in range(0, texts.num_rows, 500):
                    yield _broken(texts.slice(at, 500), options, weights, most, cumulative)


def _broken(texts: pa.Table, options: Options, weights: dict[str, float], most: int, cumulative: bool) -> pa.RecordBatch:
    column = {c: texts.column(c).combine_chunks() for c in ("doc_id", "toks", "sents", "pos", "hits", "state", "by_class")}
    lengths = pc.list_value_length(column["toks"]).to_numpy(zero_copy_only=False)
    toks, sents = column["toks"].flatten(), column["sents"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    hit = column["hits"].flatten().to_numpy(zero_copy_only=False).astype(bool)
    row, pos = _spread(lengths)
    if cumulative:
        total = np.cumsum(sents)
        sents = total - (total - sents)[(np.cumsum(lengths) - lengths)[row]] if len(row) else total
    else:
        pos = column["pos"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    state, by_class = (column[c].to_numpy().view(np.uint64) for c in ("state", "by_class"))
    new = np.append(True, (row[1:] != row[:-1]) | (sents[1:] != sents[:-1])) if len(row) else np.empty(0, bool)
    sentence, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    coded = toks.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    word = pc.index_in(coded.dictionary, options.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    token, option = drawn(options, weights, most, word, sentence, pos, hit, state[row], with_long(by_class[row[heads]], sents[heads]))
    order = np.argsort(token)
    mask = np.zeros(len(toks), bool)
    mask[token] = True
    chosen = pa.array(option[order])
    out = pc.replace_with_mask(toks, pa.array(mask), options.broken.take(chosen).cast(toks.type))
    tags = pc.replace_with_mask(pa.array(np.full(len(toks), "KEEP"), pa.string()), pa.array(mask), options.fix.take(chosen).cast(pa.string()))
    ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(pos, pa.int32()), out, tags)]
    return pa.RecordBatch.from_arrays([column["doc_id"], *lists], names=["doc_id", "pos", "toks", "tags"])
