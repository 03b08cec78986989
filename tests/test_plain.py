"""Queries that have no SQL, whole, against plain Python over the given tables."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tests.test_model import expected
from vispark.operators import corpus, encoding
from vispark.plans.catalogue import QUERIES
from vispark.plans.report_queries import MERGES, _tokenizer
from vispark.plans.rule_texts import rule_texts
from vispark.sources.files import html_nodes

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\W\d_]+")


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def _ranks():
    return {pair: i for i, pair in enumerate(MERGES)}


def test_bpe_pieces(spark, texts):
    words = {w.lower() for t in texts.values() for w in TOKEN.findall(t or "")}
    got = {r.word: r.pieces for r in QUERIES["bpe_pieces"](spark, DATA).collect()}
    assert got == {w: encoding.merge_word(w, _ranks()) for w in words} and len(got) > 1000


def test_encoded_sentences(spark, texts):
    got = {r.doc_id: r for r in QUERIES["encoded_sentences"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        words = [w.lower() for w in TOKEN.findall(text or "")]
        ids, owner, first = [0], [-1], [-1] * len(words)
        for i, w in enumerate(words):
            own = [len(p) for p in encoding.merge_word(w, _ranks())]
            if len(ids) + len(own) > encoding.MAX_PIECES - 1:
                break
            first[i] = len(ids)
            ids += own
            owner += [i] * len(own)
        labels = [len(words[o]) if o >= 0 and owner[k - 1] != o else -100 for k, o in enumerate([*owner, -1])]
        r = got[doc]
        assert (json.loads(r.ids), json.loads(r.first), json.loads(r.labels)) == ([*ids, 2], first, labels) and r.n == len(ids) + 1


def test_page_nodes(spark):
    import hashlib

    table = pq.read_table(f"{DATA}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    want = {(p, i, a, b, hashlib.md5(t.encode()).hexdigest()) for p, h in zip(table["page_id"], table["html"]) for i, (a, b, t) in enumerate(html_nodes(h))}
    assert {tuple(r) for r in QUERIES["page_nodes"](spark, DATA).collect()} == want
    assert html_nodes("a<p>b</p>c")[:2] == [(0, 1, "a"), (1, 2, "b")] and html_nodes("a<p>b</p>c")[2][0] == 3


def _options(spark, docs, least):
    counts = Counter(w.lower() for t in docs.values() for w in TOKEN.findall(t or ""))
    lexicon = spark.createDataFrame([(w,) for w, n in counts.items() if n >= least], "word string")
    words = sorted({w for t in docs.values() for w in TOKEN.findall(t or "")})
    known: dict = {}
    for r in corpus.tag_candidates(spark.createDataFrame([(w,) for w in words], "word string"), lexicon).collect():
        known.setdefault(r.word, {})[r.tag] = r.result
    return known


def test_score_text(spark, texts):
    docs = texts | {-1 - i: t for i, t in enumerate(rule_texts())}
    want = expected(list(docs.items()), _options(spark, docs, 2), "F2", 96, _tokenizer(), threshold=0.5, margin=0.1, consonant=0.4)
    got = QUERIES["score_text"](spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.end, r.original, r.suggestion, round(r.confidence, 9)) for r in got) == sorted((*w[:5], w[6]) for w in want) and len(want) > 1000


def test_scored_decisions(spark, texts):
    sentences = {tuple(TOKEN.findall(s)) for t in texts.values() for s in re.split("[.!?…\n]", t or "")} - {()}
    docs = {i: " ".join(s) for i, s in enumerate(sorted(sentences))}
    known = _options(spark, texts, 3)
    want = Counter(w[5] for w in expected(list(docs.items()), known, "F2", 96, _tokenizer(), threshold=0.5, margin=0.1, consonant=0.5))
    got = {r.decision: r.n for r in QUERIES["scored_decisions"](spark, DATA).collect()}
    assert {k: n for k, n in got.items() if k != "KEEP"} == dict(want)
