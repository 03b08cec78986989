"""Token files, packing, licences, toxicity and personal data against plain Python."""

from __future__ import annotations

import io
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vispark.llm import license_scan as ls
from vispark.llm import packing
from vispark.llm.binary_output import TokenFileReader, TokenFileWriter, read_token_files, write_token_files
from vispark.llm.boosting import BoostedTrees
from vispark.llm.packing import best_fit, cut_document, pack_documents
from vispark.llm.pii import find_pii, redacted
from vispark.llm.tokens import default_vocabulary
from vispark.llm.toxicity import drop_toxic, features, fit_severity, score_severity

TEXTS = [
    (4, "The quick  brown fox,\n jumps!! it's"), (1, None), (2, ""), (9, "x " * 5000), (3, "é😀 日本 a\tb\x1cc  "), (4, "The quick  brown fox,\n jumps!! it's"),
    (None, "no id"), (7, "<|endoftext|> said 'you''re"),
]
SCHEMA = "doc_id long, text string, start int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)


def _plain(text):
    """Ids by the untouched tokenizer."""
    if "tokenizer" not in _plain.__dict__:
        from tokenizers import Tokenizer

        _plain.tokenizer = Tokenizer.from_file(default_vocabulary())
    ids = _plain.tokenizer.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_cached_encoding_equals_the_library(monkeypatch):
    import random

    from vispark.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    e, rnd = tokens.CachedEncoder(default_vocabulary()), random.Random(5)
    odd = ["hello <|endoftext|> world", "a<|endoftext|>", "<|endoftext|>", "<|endoftext", " lead", "trail ", "two  spaces", "tab\t x", "it's don't", "漢字 かな。", "²½ Ⅷ"]
    parts = ["ab", " ", " ", " ", "3", ".", "!", "'", "\t", "\n", "é", "漢", "😀", "\x1c", "\x85", "_", "-", "²", "ǅ", "\u0301", "\u200b", "<|endoftext|>", "word", "Und"]
    odd += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    assert all(e.encode(t) == _plain(t) for t in [*odd, *(t for _, t in TEXTS)])
    assert e.encode("hello <|endoftext|> world") == struct.pack("<4I", 31373, 220, 50256, 995)
    assert len(e.young) <= 50 and len(e.old) <= 50


def test_token_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_token_files(_docs(spark, TEXTS), path, end_id=0)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 7, 9]
    at, text = 0, dict(TEXTS)
    for r in got:
        ids = _plain(text[r.doc_id]) + b"\0\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    assert sorted(r.doc_id for r in read_token_files(spark, path, doc_ids=[4, 9]).collect()) == [4, 4, 9]
    write_token_files(_docs(spark, []), path + "2")
    assert read_token_files(spark, path + "2").count() == 0


def test_token_file_frames_are_checked():
    raw = io.BytesIO()
    w = TokenFileWriter(raw, 2, frame_ids=3)
    w.add(5, struct.pack("<7I", *range(7)))
    w.add(6, b"")
    w.close()
    r = TokenFileReader(io.BytesIO(raw.getvalue()))
    assert r.ids(0) == struct.pack("<7I", *range(7)) and r.ids(1) == b""
    broken = bytearray(raw.getvalue())
    broken[-9 - 12 * 5 + 8] ^= 1  # a checksum in the table
    with pytest.raises(ValueError):
        TokenFileReader(io.BytesIO(bytes(broken))).ids(0)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PASSED", packing.PASSED)
    docs = TEXTS + [(100 + i, "word " * (1 + 37 * i % 300)) for i in range(60)]
    rows = pack_documents(_docs(spark, docs).repartition(5), length=128, end_id=2).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    want = sorted((d is not None, d or 0, k, s, n, c) for d, t in docs for k, (s, n, c) in enumerate(cut_document(_plain(t) + struct.pack("<I", 2), 128)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 128 + 1
    halves = [(i, "word " * 69) for i in range(400)] + [(1000 + i, "word " * 30) for i in range(400)]  # two of the long ones fit in no bin
    for few in (2, 64):
        packing.PASSED = few
        many = pack_documents(_docs(spark, halves).repartition(40), length=128, end_id=2).select("sequence_id").distinct().count()
        assert many <= 405
    assert pack_documents(_docs(spark, [])).count() == 0


def test_best_fit_takes_the_fullest_bin():
    assert sorted(sorted(b) for b in best_fit([7, 6, 3, 4], 10)) == [[0, 2], [1, 3]]
    assert best_fit([], 10) == []


def test_licences(spark):
    near = "Permission is hereby grantd, free of charge, to any persn obtaining a copy of this software"
    docs = [(1, "Under the MIT-License. MIT license"), (2, near), (3, None), (4, "nothing here"), (5, "😀 Licensed under the Apache Licence, Version 2.0!"), (6, "submit license")]
    out = {r.doc_id: r for r in ls.scan_licenses(_docs(spark, docs)).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].score) == (2, 2, 4, "mit", 1.0)
    assert out[2].labels == "mit" and 0.9 < out[2].score < 1 and out[2].n_base == 0
    assert (out[3].n_words, out[3].labels, out[3].score, out[3].first_word) == (0, "", 0.0, None)
    assert out[4].labels == out[6].labels == ""
    near = {20: ("Licensed under CC BY-NC 4.0", "cc-by-nc"), 21: ("licensed under CC BY-SA 4.0.", "cc-by-sa"), 22: ("Licenced under CC-BY 4.0", "cc-by"), 23: ("Licensed under the MPL license", "")}
    near |= {24: ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"), 25: ("under the tems of the GNU Affero General Public License", "agpl,gpl"), 26: ("under the terms of the GNU General Public Licence", "gpl")}
    near |= {27: ("Relased under the MIT license", "mit"), 28: ("Licensed under the BIT license", "")}
    got = {r.doc_id: r.labels for r in ls.scan_licenses(_docs(spark, [(i, t) for i, (t, _) in near.items()])).collect()}
    assert got == {i: w for i, (_, w) in near.items()}
    span = next(s for s in out[5].spans if s.label == "apache")
    assert docs[4][1][span.start : span.end] == "Licensed under the Apache Licence, Version 2.0"


def test_licence_base_against_plain_python(spark):
    import random

    rnd = random.Random(8)
    parts = ["mit", "MIT", " license", "license", "Apache", "general", "public", " ", "-", "\n", "é", "x", "İ", "K", "😀", "License.", "_", "\x7f", "\x80"]
    docs = [(i, "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "")]
    for r in ls.scan_licenses(_docs(spark, docs)).collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in dict(docs)[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        base = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in base]
        want = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and (not base or r.score == 1.0)


def test_notices_with_edits_are_found_by_seeds():
    import random

    import regex

    rnd, search = random.Random(4), ls.NoticeSearch()
    for _ in range(60):
        label, notice, telling = rnd.choice(ls.NOTICES)
        t = list(notice)
        for _ in range(rnd.randint(0, len(notice) // ls.CHARS_PER_EDIT)):
            at = rnd.randrange(1, len(t) - 1)
            t[at : at + 1] = rnd.choice([[], [t[at], "q"], ["q"]])
        text = "and so " + "".join(t) + " goes on"
        if telling and f" {telling} " not in f" {text} ":
            continue
        if regex.search(f"(?:{regex.escape(notice)}){{e<={len(notice) // ls.CHARS_PER_EDIT}}}", text):
            assert label in {h[2] for h in search.find(text)}


def _severity_by_hand(model, text):
    import math

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    names = words + [w[:n] + "-" for w in words for n in (4, 5, 6) if len(w) > n]
    score = sum(w * math.log1p(len(words) if f == "#" else names.count(f)) for f, w in model.weights.items())
    return sum(1 / (1 + math.exp(th - score)) for th in model.thresholds)


def test_toxicity_against_plain_python(spark):
    import random

    rnd = random.Random(1)
    words = lambda n: [f"w{rnd.choice('abcdefgh')}{rnd.choice('xyz')}" for _ in range(n)]
    rows = [(i, " ".join(words(20) + ([f"badword{rnd.choice('abc')}"] * (1 + i % 5) if i % 2 else []))) for i in range(200)]
    labels = [(i, 3, i % 2) for i in range(160)] + [(0, 3, 0), (161, 3, None), (None, 3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_severity(_docs(spark, rows), labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    held = {r.doc_id: r.toxic for r in score_severity(_docs(spark, rows[162:]), model).collect()}
    assert held == {i: i % 2 == 1 for i in range(162, 200)}
    odd = [(1, "wax badworda badworda"), (2, "wax wby"), (3, None), (4, ""), (None, "badwordb " * 9), (5, "BADWORDA\tbadwordc. 12 x" + " wax" * 3000), (1, "wax badworda badworda")]
    out = score_severity(_docs(spark, odd), model).collect()
    assert len(out) == len(odd)
    for r in out:
        text = next(t for i, t in odd if i == r.doc_id)
        assert r.severity == pytest.approx(_severity_by_hand(model, text)) and r.toxic == (r.severity >= model.cut)
    by = {r.doc_id: r for r in out}
    assert by[1].toxic and by[None].toxic and not (by[2].toxic or by[3].toxic or by[4].toxic)
    assert by[3].hits == by[4].hits == 0 and by[1].hits == 8
    for nothing in (labels.limit(0), labels.where("toxic = 1")):
        assert not score_severity(_docs(spark, odd), fit_severity(_docs(spark, rows), nothing)).where("toxic").count()
    assert score_severity(_docs(spark, []), model).count() == 0
    extra = _docs(spark, odd).withColumns({c: F.lit(1) for c in ("toxic", "s", "row", "severity")})
    kept = drop_toxic(extra, model)
    assert kept.columns == extra.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert "badw-" in features("badword")


def test_toxicity_catches_held_out_rows(spark):
    """Recall and false alarms on labelled rows that the fit has not seen."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0
    model = fit_severity(docs, labels.where(seen))
    out = score_severity(docs, model).join(labels.where(~seen).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    n = {(r.label, r.toxic): r["count"] for r in out.groupBy("label", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.88
    assert n.get((0, True), 0) / n[0, False] <= 0.02


@pytest.mark.parametrize(("sf", "recall"), [("sf0.1", 0.9), ("sf0.01", 0.82)])
def test_toxicity_on_rows_that_its_folds_have_not_seen(spark, sf, recall):
    """The folds of the fit itself: recall, false alarms, and severity going up with the grade.

    About one toxic row in fourteen has no word that other toxic rows have; of the 51 of sf0.01, 38 are left to learn from.
    """
    base = f"/root/testdata/{sf}"
    model = fit_severity(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))
    toxic, clean = [s for s, t, _ in model.unseen if t], [s for s, t, _ in model.unseen if not t]
    assert len(clean) > 300 and len(toxic) > 40
    assert sum(s >= model.cut for s in toxic) >= recall * len(toxic)
    assert sum(s >= model.cut for s in clean) <= 0.02 * len(clean)
    means = [sum(x) / len(x) for x in ([s for s, _, g in model.unseen if g == k] for k in range(4)) if x]
    assert len(means) == 4 and means == sorted(means)


def _base(text):
    out = []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


def test_personal_data(spark):
    import random

    rnd = random.Random(3)
    parts = ["a@b.c", "_d@e.f", ".", " ", "-", "+", "+1 (555) 123-4567", "4465758382889437", "1", "12", ".25", "255.1.2.3", "999.1.1.1", "@", "x", "😀", "é", "\n", "(", "+4 ) - "]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "9" * 20_000), (1003, "call (415) 555-2671 or token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"")]
    found = find_pii(_docs(spark, docs))
    rows = {r.doc_id: r for r in found.collect()}
    for i, t in docs:
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == _base(t or "")
        assert {tuple(s) for s in rows[i].base} <= {tuple(s) for s in rows[i].spans}
    assert {s.kind for s in rows[1003].spans} >= {"phone", "secret"}
    assert redacted(found.where("doc_id = 1003")).first().text.startswith("call [PHONE] or")
    assert find_pii(_docs(spark, [])).count() == 0


def test_planted_spans_are_found_among_documents(spark):
    """Precision and recall of all spans in real documents with personal data, and with look-alikes, put in."""
    import random

    rnd = random.Random(12)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: rnd.choice(["maria", "j.doe", "li_wei", "support", "o.hara"]) + d(rnd.randint(0, 2))
    host = lambda: rnd.choice(["gmail", "mail.example", "acme-corp", "uni"])
    planted = {
        "email": lambda: rnd.choice(["{}@{}.com", "{} at {}.org", "{} (at) {} (dot) net", "{} [at] {} [dot] edu"]).format(name(), host()),
        "phone": lambda: rnd.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 {} {} {}"]).format("2" + d(2), "5" + d(2), d(4)),
        "ssn": lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
        "secret": lambda: rnd.choice(["key = ", "token: ", "password="]) + "".join(rnd.choice("abcdef0123456789") for _ in range(32)),
    }
    before = {"email": ["write to", "mail", "contact"], "phone": ["call", "phone", "tel"], "ssn": ["SSN", "social security number"], "secret": ["the", "with"]}
    alike = ["ISBN 978-3-16-148410-0", "version 10.2.3", "order 2023-11-05", "page 412", "in 1998-2004", "3.14159", "at noon", "12:30:45", "a ratio of 16:9", "available at github.com"]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    plain = {r.doc_id: {tuple(s) for s in r.spans} for r in find_pii(_docs(spark, list(enumerate(texts)))).collect()}
    docs, want = [], {}
    for i, text in enumerate(texts):
        if plain[i]:
            continue
        kind = rnd.choice(list(planted))
        lead, span, tail = text[:400].rsplit(" ", 1)[0] + f" {rnd.choice(before[kind])} ", planted[kind](), f" and {rnd.choice(alike)} now. "
        docs.append((i, lead + span + tail + text[400:900]))
        want[i] = (kind, len(lead), len(lead) + len(span))
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in find_pii(_docs(spark, docs)).collect()}
    assert len(docs) > 80
    hits = sum(want[i] in got[i] for i, _ in docs)
    extra = sum(len([s for s in got[i] if s[2] <= want[i][1] or s[1] >= want[i][2]]) for i, _ in docs)
    assert hits / len(docs) >= 0.9 and hits / (hits + extra) >= 0.9, (hits, len(docs), extra)


def test_many_matches_take_no_quadratic_time(spark):
    import time

    text = " ".join(str(37 * i % 1_000_003) for i in range(200_000))
    begun = time.time()
    r = find_pii(_docs(spark, [(1, text + " mail a@b.c 1.2.3.4")])).first()
    assert time.time() - begun < 60 and (r.base[0].kind, r.base[0].start) == ("email", len(text) + 6)


def test_proposed_gates_are_necessary(spark):
    mails = ("john.smith at gmail.com", "john.smith(AT)gmail(DOT)com", "john [At] gmail [DOT] com", "john AT gmail DOT com", "john(at)gmail.com")
    docs = [(i, f"Please write to {m} soon") for i, m in enumerate(mails)]
    docs += [(100, "It is available at github.com for free"), (101, "We met at noon.Then all left"), (102, "Look at this")]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find_pii(_docs(spark, docs)).collect()}
    assert spans == {i: [("email", 16, 16 + len(m)) for m in mails[i : i + 1]] for i, _ in docs}


def test_trees_and_their_sql_agree(spark):
    import random

    rnd = random.Random(2)
    x = [[rnd.random(), rnd.random()] for _ in range(300)]
    y = [int(a > 0.5 or b > 0.8) for a, b in x]
    trees = BoostedTrees.fit(x, y, rounds=10)
    scores = trees.scores(x)
    assert sum((s > 0) == bool(v) for s, v in zip(scores, y)) > 285
    df = spark.createDataFrame([tuple(r) for r in x], "f0 double, f1 double").selectExpr("struct(f0, f1) AS r")
    assert [r[0] for r in df.selectExpr(trees.sql("r")).collect()] == pytest.approx(scores)
