"""Window plans, byte pairs, gate and the run from text to issues against plain Python."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vispark.functions.alphabet import FINAL_TAGS, INITIAL_TAGS, TAGS
from vispark.functions.groups import display_group
from vispark.operators import corpus, decisions, encoding, model, windows


def plan(counts, budget, fallback):
    n = len(counts)
    if not n:
        return []
    if sum(counts) <= budget or fallback == "none":
        return [(0, n)]
    size, stride = windows.PLANS[fallback]
    size = min(size, budget)
    offs = [sum(counts[:i]) for i in range(n + 1)]
    out, at = [], 0
    while True:
        to = at + 1
        while to < n and offs[to + 1] - offs[at] <= size:
            to += 1
        out.append((at, to))
        if to == n:
            return out
        after = to
        if stride is not None:
            after = at + 1
            while after < to and offs[after] < offs[at] + stride:
                after += 1
        at = after


def owners(counts, runs):
    offs, best = [sum(counts[:i]) for i in range(len(counts) + 1)], {}
    for r, (a, b) in enumerate(runs):
        for w in range(a, b):
            deep = min(offs[w] - offs[a], offs[b] - offs[w + 1])
            if w not in best or deep > best[w][0]:
                best[w] = deep, r
    return {w: r for w, (_, r) in best.items()}


RANDOM = random.Random(4)
CASES = [
    [1, 2, 1, 1], [1] * 200, [1 + (i % 3 == 0) for i in range(150)], [1 + (i % 4 == 0) for i in range(150)], [1, 1, 70, 1, 1, *[1] * 60], [], [6] * 10, [200, 1, 1, 90, 5], [40] * 5,
    *[[RANDOM.choice([1, 1, 2, 3, 30]) for _ in range(RANDOM.randint(1, 250))] for _ in range(20)],
]


@pytest.mark.parametrize("fallback", windows.PLANS)
def test_window_plans(spark, fallback):
    rows = windows.run_plan(spark.createDataFrame(list(enumerate(CASES)), "key int, counts array<int>"), fallback)
    got = {r.key: [tuple(w) for w in r.plan] for r in rows.collect()}
    assert got == {i: plan(c, 94, fallback) for i, c in enumerate(CASES)}
    assert got[6] == [(0, 10)]  # ten words of six pieces fit
    assert fallback in ("F1", "none") or all(b[0] < a[1] for a, b in zip(got[2], got[2][1:]))  # sliding windows overlap
    picked: dict = {}
    for r in windows.centred(rows).collect():
        assert r.word not in picked.setdefault(r.key, {})
        picked[r.key][r.word] = r.run
    assert picked == {i: owners(c, got[i]) for i, c in enumerate(CASES) if c}


def test_window_plans_are_linear_and_named(spark):
    with pytest.raises(ValueError):
        windows.run_plan(spark.createDataFrame([([1],)], "counts array<int>"), "F3")
    long = spark.range(1).select(F.lit(0).alias("key"), F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: 1 + i % 3 % 2).alias("counts"))
    windows.run_plan(long.limit(1), "F2").select(F.size("plan")).collect()
    begun = time.time()
    assert windows.run_plan(long, "F2").select(F.size("plan")).first()[0] > 4000
    assert time.time() - begun < 5


def test_byte_pairs_by_heap():
    merges = [("a", "b"), ("ab", "ab"), ("b", "a"), ("c", "c"), ("cc", "c"), ("abab", "c</w>"), ("a", "a"), ("aa", "a")]
    ranks = {pair: i for i, pair in enumerate(merges)}

    def scanned(word):
        parts = [*word[:-1], word[-1] + "</w>"] if word else []
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, 99), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 99:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [p + "@@" for p in parts[:-1]] + [p[:-4] for p in parts[-1:]]

    for _ in range(300):
        word = "".join(RANDOM.choice("abc") for _ in range(RANDOM.randint(0, 30)))
        assert encoding.merge_word(word, ranks) == scanned(word)
    begun = time.time()
    assert len(encoding.merge_word("abc" * 33_334, ranks)) > 1000
    assert time.time() - begun < 1.5


def test_gate_by_tag_and_plan(spark):
    rows = spark.createDataFrame([(["KEEP", "D_GI", "D_R"], [0.0, 2.0, 1.0]), (["D_R", "KEEP"], [1.0, 0.0]), (["KEEP"], [3.0]), ([], [])], "tags array<string>, logits array<double>")
    got = decisions.gate(rows, 0.5, 0.1, 0.5, {"D_GI": 0.99}).collect()
    assert [r.decision for r in got] == ["KEEP", "D_R", "KEEP", "KEEP"] and [r.best for r in got] == ["D_GI", "D_R", None, None]
    assert got[0].best_p == pytest.approx(math.exp(2) / (1 + math.exp(2) + math.exp(1))) and got[2].keep_p == 1.0 and got[2].best_p == 0.0
    assert decisions.gate(rows, 0.5, 0.1, 0.5).first().decision == "D_GI"
    optimised = decisions.gate(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"transform\([^()]*\([^()]*lambdafunction\([^()]*(aggregate|array_max)\(", optimised)


MERGES = [("n", "g</w>"), ("t", "r"), ("c", "h"), ("ẻ", "</w>"), ("s", "ẽ</w>"), ("i", "ế"), ("ch", "i")]
PIECES = [p + e for p in [*"abcdeghiklmnopqrstuvxyăâđêôơưáẻẽếừ", "ng", "tr", "ch", "sẽ"] for e in ("", "@@")]
TOKENIZER = model.Tokenizer({p: i + 4 for i, p in enumerate(PIECES)}, MERGES)
TEXT = "Chia sẽ nữa thì tốt. Nghĩ lại nỗ lực sẻ trở nên dể hơn!\nTre xanh... giá 3.5 triệu, Chia sẽ nữa thì tốt"
LONG = " ".join(["sẻ chia tre no sữa dành rành giành", "Lo lắng X"][i % 2] for i in range(60))


def expected(docs, known, fallback, max_pieces, tokenizer=None, **bars):
    """doc_id, start, end, original, suggestion, tag, confidence by plain loops; the options of words come from the tested table."""
    run = model.hash_model(None)
    tokenizer = tokenizer or TOKENIZER
    ranks = {pair: i for i, pair in enumerate(tokenizer.merges)}
    out = []
    for doc, text in docs:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "")]
        sentences, at = [], 0
        for i in range(1, len(spans)):
            if re.search(r"[.!?…\n]", text[spans[i - 1][1] : spans[i][0]]):
                sentences.append(spans[at:i])
                at = i
        if spans:
            sentences.append(spans[at:])
        for some in sentences:
            words = [text[a:b] for a, b in some]
            ids = [[tokenizer.vocabulary.get(p, 3) for p in encoding.merge_word(w, ranks)] for w in words]
            counts = [len(x) for x in ids]
            runs = plan(counts, max_pieces - 2, fallback)
            own = owners(counts, runs)
            for r, (a, b) in enumerate(runs):
                flat, first = [0], {}
                for i in range(a, b):
                    if len(flat) + counts[i] > max_pieces - 1:
                        break
                    first[i] = len(flat)
                    flat += ids[i]
                flat.append(2)
                logits = run(np.array([flat]), np.ones((1, len(flat))))[0]
                for i in range(a, b):
                    options = known.get(words[i], {})
                    if own[i] != r or i not in first or len(options) < 2:
                        continue
                    e = {t: math.exp(logits[first[i]][TAGS.index(t)]) for t in options}
                    best = max((t for t in options if t != "KEEP"), key=lambda t: (e[t], -TAGS.index(t)))
                    p, keep = e[best] / sum(e.values()), e["KEEP"] / sum(e.values())
                    if p >= bars["consonant" if best in (*INITIAL_TAGS, *FINAL_TAGS) else "threshold"] and p - keep >= bars["margin"]:
                        out.append((doc, *some[i], words[i], options[best], best, round(p, 9)))
    return sorted(out)


@pytest.mark.parametrize(("fallback", "max_pieces"), [("F2", 96), ("F1", 60), ("F2s", 96), ("none", 40)])
def test_text_to_issues(spark, fallback, max_pieces, tmp_path):
    docs = [(1, TEXT), (2, None), (3, ""), (4, LONG), (5, LONG + ". " + TEXT), (6, "sẽ"), (6, "sẽ"), (7, "123 !!!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    vocabulary = [w.lower() for w in "sẽ sẻ chia tre che no lo giành dành rành xanh sanh dễ dể nữa nửa sữa sửa".split()]
    lexicon = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    words = sorted({w for _, t in docs for w in re.findall(r"[^\W\d_]+", t or "")})
    known: dict = {}
    for r in corpus.tag_candidates(spark.createDataFrame([(w,) for w in words], "word string"), lexicon).collect():
        known.setdefault(r.word, {})[r.tag] = r.result
    (tmp_path / "seed").write_text("0")
    file = model.ModelFile(model.hash_model, str(tmp_path / "seed"))
    bars = {"threshold": 0.5, "margin": 0.1, "consonant": 0.4}
    got = model.score_text(df, file, TOKENIZER, lexicon, fallback, max_pieces, batch=3, **bars)
    rows = got.collect()
    want = expected(docs, known, fallback, max_pieces, **bars)
    assert len(want) > 5
    groups = {tuple(r)[:3]: r.g for r in spark.createDataFrame([w[3:6] for w in want], "o string, s string, t string").withColumn("g", display_group(F.col("t"), F.col("o"), F.col("s"))).collect()}
    assert sorted((r.doc_id, r.start, r.end, r.original, r.suggestion, r.tag, round(r.confidence, 9)) for r in rows) == sorted((*w[:5], groups[w[3:6]], w[6]) for w in want)
    assert all(r.source == "model" and r.why == f'Model đề xuất "{r.suggestion}" ({math.floor(r.confidence * 100 + 0.5)}%).' for r in rows)


def test_a_sentence_that_stands_everywhere(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("Chia sẽ nữa thì tốt").alias("text"))
    once = model.score_text(docs.limit(1), model.ModelFile(model.hash_model), TOKENIZER, threshold=0.1, margin=-1.0, consonant=0.1).count()
    assert once > 1
    found = model.score_text(docs, model.ModelFile(model.hash_model), TOKENIZER, threshold=0.1, margin=-1.0, consonant=0.1)
    assert found.groupBy("doc_id").count().groupBy("count").count().collect() == [(once, 100_000)]
    assert model.score_text(docs.limit(0), model.ModelFile(model.hash_model), TOKENIZER).count() == 0
