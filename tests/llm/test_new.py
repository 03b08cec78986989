"""Spelling variants, line dedup and collocations against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from vispark.llm import collocations as co
from vispark.llm import spelling
from vispark.llm.line_dedup import LineRuns, drop_repeated_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word int, key string, n int, phrase string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "k", 1, "p", 3) for i, t, lang in rows], DOCS)


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        close = [(-counts[v], v) for v in counts if near(w, v)]
        best = min(close) if close else None
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [len(close), form[w], -best[0] if form[w] else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: (f, r, counts[w], k, fn) for w, (k, f, fn, r) in out.items()}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("shard", [3, 100_000])
def test_spelling_variants(spark, shard):
    dice, counts = random.Random(1), {}
    stems = ["abcdef", "aaaaaa", "abcabc", "éèêëàé", "ananan", "banane"]
    for _ in range(400):
        w = list(dice.choice(stems))
        for _ in range(dice.randint(0, 2)):
            i = dice.randrange(len(w) + 1)
            w[i : i + dice.randint(0, 1)] = dice.choice(["", "a", "b", "é"])
        if len(w) >= 6:
            counts["".join(w)] = dice.choice([5, 5, 6, 25, 30, 150, 900, 5000])
    for w, n in (("zzzzzz", 5), ("zzzzzzz", 25), ("zzzzzzzz", 125), ("zzzzzzzzz", 625), ("q" * 3000, 9), ("q" * 2999, 45)):
        counts[w] = n
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), shard_halves=shard))
    want = variants(counts)
    assert got == want and want["zzzzzz"][1] == "zzzzzzzzz" and sum(v[3] for v in want.values()) > 500
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), shard_halves=shard).count() == 0


def test_many_words_with_one_half(spark):
    counts = {"common" + "".join(p): 5 + i for i, p in enumerate([a + b + c for a in "abcde" for b in "abcde" for c in "abcdef"])}
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == variants(counts)


def test_words_of_documents(spark):
    dice = random.Random(2)
    text = lambda: " ".join(dice.choice(["Wonderful", "wonderfull", "étudiants", "short", "x1yyyyyyy2"]) for _ in range(300))
    docs = [(i, text(), "en") for i in range(12)] + [(None, "Wonderful", "en"), (5, None, "en"), (6, "", None), (3, "w" * 50_000, "en")] + [(4, "Nowhere nowhere", "en")] * 3
    runs = spelling.letter_runs(frame(spark, docs))
    got = {r.word: r.n for r in spelling.word_counts(runs.select(spelling.with_slips(runs).alias("word"))).collect()}
    want = Counter()
    for i, t, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def lines_dropped(docs, least):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, t, _ in docs for k in {key(s) for s in (t or "").split("\n")} if k)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if found[key(s)] < least]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_repeated_lines(spark, batches):
    dice = random.Random(3)
    pool = ["Cookie notice", " cookie NOTICE\t", "É a", "é a", "", "  ", "x", "tail\r", "a b", "a  b"] + [f"own {i}" for i in range(60)]
    docs = [(dice.choice([i, None, 3]), dice.choice(["\n", "\n\n"]).join(dice.choice(pool) for _ in range(dice.randint(1, 12))), "en") for i in range(60)]
    docs += [(7, "x\nown 1", "en")] * 5 + [(None, None, None), (8, "", "en"), (9, "\n" * 20_000 + "cookie notice", "en")]
    got = drop_repeated_lines(frame(spark, docs), 10, batches).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == lines_dropped(docs, 10)
    assert drop_repeated_lines(frame(spark, docs).limit(0), 10, batches).count() == 0


def test_runs_are_merged_by_level(spark):
    runs, want = LineRuns(spark, 3, buckets=2), Counter()
    settled_at = {}
    for b in range(7):
        some = [f"k{k}" for k in range(5) for _ in range(b % (k + 1))] or ["k9"]
        for k in some:
            want[k] += 1
        runs.add(spark.createDataFrame([(k.encode(),) for k in some], "key binary"))
        settled_at[b] = [bool(x) for x in runs.levels]
    assert settled_at == {0: [True], 1: [False, True], 2: [True, True], 3: [False, False, True], 4: [True, False, True], 5: [False, True, True], 6: [True, True, True]}
    assert sorted(bytes(r.key).decode() for r in runs.settled().collect()) == sorted(k for k, n in want.items() if n >= 3)
    runs.close()
    assert LineRuns(spark).settled().count() == 0


def phrases(docs, max_words, least, best):
    grams, totals = {}, Counter()
    for _, t, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in grams.items():
        n, rows = totals[lang], []
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {p[i:j] for p, a in good.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[p[i:j]] == a}
        for p, a in good.items():
            if p not in hidden:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("coded", "share"), [(150_000, 1.0), (3, 1.0), (150_000, 0.02), (0, 0.01)])
def test_collocations(spark, monkeypatch, coded, share):
    monkeypatch.setattr(co, "HOT_SHARE", share)
    monkeypatch.setattr(co, "HELD", 200)
    dice = random.Random(4)
    words = ["The", "the", "of", "é", "a\x01", "a", "new", "york", "City", "日本", "x" * 300]
    text = lambda n: "".join(dice.choice(words) + dice.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(n))
    docs = [(i, text(40), dice.choice(["en", "fr", None])) for i in range(60)] + [(1, "new york city hall", "en")] * 9 + [(2, None, "en"), (3, "", "xx"), (4, "the " * 3000, "en"), (None, "!!!", None)]
    got = co.collocations(frame(spark, docs), min_count=8, best=25, coded=coded)
    assert sorted(tuple(r) for r in got.collect()) == phrases(docs, 5, 8, 25)
    assert co.collocations(frame(spark, docs).limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, x, y = 3_000_000_000_000, 16_000_000_000_000_001, 7_000_000_000_001, 9_000_000_000_007
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    r = co.with_scores(table([("en", "u v", a)], "lang string, phrase string, a long"), table([("en", "u", x), ("en", "v", y)], "lang string, word string, n long"), table([("en", n)], "lang string, n long")).first()
    assert (r.l, r.r, r.score) == (x, y, 1000 * a * n // (x * y))


def test_codes_are_single_characters():
    assert [len((co.code(i) or "").encode()) for i in (0, 93, 94, 94 + 1886, 94 + 1887, 94 + 1887 + 53_247, 94 + 1887 + 53_248)] == [1, 1, 2, 2, 3, 3, 0]
    assert len({co.code(i) for i in range(55_000)}) == 55_000 and not {co.code(i) for i in range(55_000)} & set(" \t\n")


def test_suffixes_travel_by_bucket(spark):
    """What a task hands on is a row for each bucket and language, however many first words it has."""
    held = co.Suffixes({"en": {"a": 3}}, 5, 4)
    words = [chr(0x100 + i) for i in range(2000)] + ["a", "b", "a", "c"]
    held.add("en", words)
    batch = held.given_out()
    assert batch.num_rows <= 4
    assert sum(map(len, batch.column("heads").to_pylist())) == 2003 and sum(map(sum, batch.column("n").to_pylist())) == len(words) - 1
