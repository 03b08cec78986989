"""Top-k search, shingle joins and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vispark.llm import ngram_join
from vispark.llm.components import components
from vispark.llm.shingles import shingle_set, word_hashes
from vispark.llm.top_k_search import SortedLists, exact_top_k


def test_threshold_algorithm_is_exact_and_stops_early():
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 6, (500, 3))
    v[:5] *= 30
    lists = SortedLists(np.arange(500), np.arange(500), v)
    for q in (v[0], v[100], np.zeros(3, int)):
        want = sorted((-int(v[j] @ q), j) for j in range(500) if j != 7)[:5]
        assert lists.top(q, 7, 5) == [(j, -s) for s, j in want]
    lists.scored = 0
    lists.top(v[0], 0, 2)
    assert lists.scored < 400


def test_top_k_over_a_table(spark, monkeypatch):
    from vispark.llm import top_k_search

    monkeypatch.setattr(top_k_search, "BLOCK_VECTORS", 40)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(0, 200)]
    rows += [(None, [1.0] * 4, 0), (201, None, 0), (202, [1.0, None, 0.0, 0.0], 0), (203, [float("nan")] * 4, 0), (204, [float("inf")] * 4, 0), (205, [0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = {i: np.floor(256 * np.array(np.float32(e), float)).astype(int) for i, e, _ in rows if i is not None and (i < 200 or i == 205)}
    good[205] = np.append(good[205], [0, 0, 0])
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in exact_top_k(df).collect()) == sorted(want)
    assert exact_top_k(df.limit(0)).count() == 0


def _brute(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if t else []
        w = [x for x in w if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted((d is not None, d or 0, len(sets[k]), least.get(find(k), -1)) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("short", [2, 24])
def test_near_duplicates(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    rnd = random.Random(short)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstu")
    shared = [word() for _ in range(60)]
    base = [[word() for _ in range(80)] for _ in range(3)]
    texts = []
    for _ in range(90):
        t = list(rnd.choice(base)) if rnd.random() < 0.8 else shared + [word() for _ in range(rnd.randint(2, 40))]
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [None, "", "  ", "one two", "ONE  two", "five words are here now", texts[0], texts[0].upper()]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (None, texts[1]), (None, "alone with no id at all")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = ngram_join.near_duplicates(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == _brute(rows)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_hash_alike_in_blocks(monkeypatch):
    from vispark.llm import shingles

    text = " ".join(f"w{i % 977}" for i in range(30_000))
    whole = word_hashes(text)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (word_hashes(text) == whole).all() and len(shingle_set("")) == 0


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u long, v long")
    assert {(r.u, r.v) for r in components(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(101, 100)}
    assert components(edges.limit(0)).count() == 0
