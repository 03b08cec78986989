"""Encoding, scoring, sampling, reports and sources against plain Python."""

from __future__ import annotations

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from vispark.operators import corpus, encoding, reports, sampling, scoring
from vispark.sources import files

MERGES = [("t", "h"), ("th", "e</w>"), ("i", "n"), ("in", "g</w>"), ("e", "r"), ("a", "n")]


def _pieces(word):
    parts = [*word[:-1], word[-1] + "</w>"]
    for pair in MERGES * 3:  # ranks in order; no later merge of these makes an earlier one possible again
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == pair:
                parts[i : i + 2] = ["".join(pair)]
            i += 1
    return [p + "@@" for p in parts[:-1]] + [parts[-1].removesuffix("</w>")]


def test_encoding_against_plain_python(spark, tmp_path):
    sentences = [("a", ["the", "thing", "ran", "there"]), ("b", ["x" * 9] * 3), ("c", []), ("d", ["unknown?", "the"]), ("e", ["y" * 40, "the"])]
    words = {w for _, ws in sentences for w in ws}
    got = {r.word: r.pieces for r in encoding.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"), MERGES).collect()}
    assert got == {w: _pieces(w) for w in words}
    ids = {w: [10 + len(p) for p in _pieces(w)] for w in words if w != "unknown?"}
    table = spark.createDataFrame(list(ids.items()), "word string, ids array<int>")
    rows = spark.createDataFrame(sentences, "key string, words array<string>")
    out = {r.key: r for r in encoding.encode_words(rows, table, 20).withColumn("labels", encoding.align_labels(F.col("word_ids"), F.transform("words", lambda w: F.length(w)))).collect()}
    for key, ws in sentences:
        want, owner, first = [0], [-1], [-1] * len(ws)
        for i, w in enumerate(ws):
            some = ids.get(w, [3])
            if len(want) + len(some) > 19:
                break
            first[i] = len(want)
            want += some
            owner += [i] * len(some)
        r = out[key]
        assert (r.ids, r.word_ids, r.first) == ([*want, 2], [*owner, -1], first)
        assert r.labels == [len(ws[o]) if o >= 0 and owner[i - 1] != o else -100 for i, o in enumerate([*owner, -1])]
    vocabulary = spark.createDataFrame([("the", 5), ("a@@", 4)], "piece string, id int")
    merges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MERGES)], "rank int, left string, right string")
    encoding.write_tokenizer(vocabulary, merges, str(tmp_path / "t"))
    assert encoding.read_tokenizer(spark, str(tmp_path / "t")) == ({"the": 5, "a@@": 4}, MERGES)
    (tmp_path / "m").write_text("#version 1\nt h 7\nth e</w> 3\n")
    assert [(r.left, r.right) for r in encoding.read_merges(spark, str(tmp_path / "m")).orderBy("rank").collect()] == [("t", "h"), ("th", "e</w>")]
    counts = spark.createDataFrame([(0, 5), (7, 2), (9, 1)], "id long, n long")
    remap = encoding.trimmed_ids(spark.range(12), counts, 2, [0, 1])
    assert sorted(tuple(r) for r in remap.collect()) == [(0, 0), (1, 1), (7, 2)]
    assert {r.fault: r.n for r in encoding.remap_faults(remap, counts, 1).collect()} == {"old repeats": 0, "new repeats": 0, "unordered": 0, "missing": 1}


def test_bars_and_the_policy_they_leave(spark):
    rows = [("x", 0.96, 0.01, 0.01, 0.5, 0.4, 0.01), ("y", 0.97, 0.01, 0.005, 0.5, 0.4, 0.01), ("z", 0.9, 0.0, 0.0, 0.4, 0.4, 0.01)]
    judged = scoring.with_bars(spark.createDataFrame(rows, "policy string, precision double, bao_oan_a double, bao_oan_b double, phu_am double, d_gi_r double, sua_sai_dgir double"))
    assert {r.policy: r.failed for r in judged.collect()} == {"x": "", "y": "", "z": "precision,phu_am"}
    assert scoring.pick_policy(judged, "bao_oan_a", "bao_oan_b").first().policy == "y"


def test_scopes_confusions_and_samples(spark):
    known = spark.createDataFrame([(w,) for w in ("sẽ", "sẻ", "tre", "che", "lo", "no", "xa")], "word string")
    pairs = spark.createDataFrame([("sẻ", "sẽ", "sẽ"), ("che", "tre", "che"), ("zzz", "sẽ", "sẽ"), ("lo", "lo", "no"), ("xa", "xa", "xa")], "wrong string, want string, got string")
    r = reports.scope_report(pairs, known).first()
    assert (r.errors, r.in_scope, r.other_length, r.ratio) == (3, 2, 1, pytest.approx(2 / 3))
    assert [tuple(x) for x in reports.scope_examples(pairs, known).collect()] == [("zzz", "sẽ")]
    c = reports.scoped_confusion(pairs, known).first()
    assert (c.tp, c.fp, c.fn) == (1, 1, 1)
    found = {(x.word, x.bad, x.tag) for x in sampling.confusions(known, known).collect()}
    assert found == {("tre", "che", "CH_TR"), ("che", "tre", "TR_CH"), ("lo", "no", "N_L"), ("no", "lo", "L_N")}
    assert corpus.unbroken(F.array(F.lit("a")), F.array(F.lit("KEEP"))) is not None
    one = spark.createDataFrame([(["sẻ", "Che", "no"], ["TONE_NGA", "CH_TR", "KEEP"])], "t array<string>, g array<string>").select(corpus.unbroken(F.col("t"), F.col("g"))).first()[0]
    assert one == ["sẽ", "Tre", "no"]
    with pytest.raises(ValueError):
        sampling.sample_rows(known, "word", 99)
    counts = [40, 40, 20, 1, 93, 200, 1]
    out = sampling.packed_chunks(spark.createDataFrame([(counts,)], "counts array<int>")).first().chunk
    assert out == [0, 0, 1, 1, 2, 3, 4]
    far = spark.createDataFrame([(0, "a", "b"), (0, "a", "a"), (12, None, None), (9, "a", None)], "distance int, a string, b string")
    assert sorted(tuple(x) for x in reports.disagreement_by_distance(far).collect()) == [(0, 2, 1, 0.5), (9, 2, 1, 0.5)]


def test_sources_round_trip(spark, tmp_path):
    decomposed = unicodedata.normalize("NFD", "sẻ")
    rows = [
        {"text": "một", "annotations": [{"current_syllable": "«sẽ,»", "is_correct": False, "alternative_syllables": [decomposed + "."]}, {"current_syllable": "—", "is_correct": True, "alternative_syllables": []}]},
        {"text": "hai", "annotations": [{"current_syllable": "ba", "is_correct": False, "alternative_syllables": ["..."]}, {"current_syllable": "tư", "is_correct": False, "alternative_syllables": []}]},
        {"text": "ba", "annotations": [{"current_syllable": "!", "is_correct": True, "alternative_syllables": []}]},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    got = {r.text: (r.wrong, r.want) for r in files.read_annotated(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"một": (["sẽ"], ["sẻ"]), "hai": (["ba", "tư"], ["ba", "tư"])}
    halves = [files.read_annotated(spark, str(tmp_path / "a.jsonl"), s).count() for s in ("mine", "eval")]
    assert sum(halves) == 2
    samples = spark.createDataFrame([("train", ["a"], ["KEEP"]), ("dev", ["b", "c"], ["KEEP", "KEEP"]), ("dev", ["b"], [])], "split string, tokens array<string>, tags array<string>")
    files.write_samples(samples, str(tmp_path / "s"))
    assert sorted(r.tokens for r in files.read_samples(spark, str(tmp_path / "s")).collect()) == [["a"], ["b", "c"]]
    assert files.read_samples(spark, str(tmp_path / "s"), limit=1).count() <= 1
    lexicon = spark.createDataFrame([("b", 3), ("a", 9)], "word string, cnt long")
    files.write_lexicon(lexicon, str(tmp_path / "l"))
    assert sorted(tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "l")).collect()) == [("a", 9), ("b", 3)]
    files.write_lexicon_json(lexicon, str(tmp_path / "lj"))
    assert [r.word for r in files.read_lexicon_json(spark, str(tmp_path / "lj")).collect()] == ["a", "b"]
    weights = spark.createDataFrame([("x", 0.5), ("y", 2.0)], "key string, weight double")
    files.write_weights(weights, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in files.read_weights(spark, str(tmp_path / "w")).collect()) == [("x", 0.5), ("y", 2.0)]
    assert files.read_weights(spark, str(tmp_path / "absent")).count() == 0
    files.write_report(weights, str(tmp_path / "r"), {"model": "m"})
    assert files.read_report(spark, str(tmp_path / "r"), "key string, weight double").first()._meta == {"model": "m"}
    files.write_lines(lexicon, str(tmp_path / "t"), "word")
    assert files.read_lines(spark, str(tmp_path / "t")).count() == 2
    encoding.write_token_cache(spark.createDataFrame([([1, 2], [3, -100])], "ids array<long>, labels array<long>"), str(tmp_path / "c"))
    assert tuple(encoding.read_token_cache(spark, str(tmp_path / "c")).first()) == ([1, 2], [3, -100])


def test_pages_fields_and_settings(spark):
    html = "<div>Một &amp; hai<b> ba</b></div><script>x()</script><p>bốn</p><pre>no</pre><ul><li>năm</li></ul>"
    nodes = files.html_nodes(html)
    assert [t for *_, t in nodes] == ["Một & hai", " ba", "bốn", "năm"]
    assert [(a, b) for a, b, _ in nodes] == [(0, 9), (9, 12), (13, 16), (17, 20)]
    assert files.html_nodes(None) == [] == files.html_nodes("")
    fields = [
        (1, "TEXTAREA", None, None, None, None, None, None, "x" * 12), (2, "input", "text", "off", "comment", None, None, None, "x" * 12), (3, "input", "password", None, None, None, None, None, "x" * 12),
        (4, "input", None, "cc-number", None, None, None, None, "x" * 12), (5, "textarea", None, None, "Search box", None, None, None, "x" * 12), (6, "div", None, None, None, True, None, None, "x" * 12),
        (7, "div", None, None, None, None, None, None, "x" * 12), (8, "textarea", None, None, None, None, True, None, "x" * 12), (9, "div", None, None, None, True, None, True, "x" * 12), (10, "textarea", None, None, None, None, None, None, "short"),
    ]
    df = spark.createDataFrame(fields, "id int, tag string, type string, autocomplete string, hints string, editable boolean, locked boolean, code boolean, text string")
    assert sorted(r.id for r in files.eligible(df).collect()) == [1, 2, 6]
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    changes = spark.createDataFrame([("a", "3", 1), ("a", "4", 2), ("b", None, 3), ("c", "5", 1)], "key string, value string, seq int")
    assert sorted(tuple(r) for r in files.settings_after(stored, changes).collect()) == [("a", "4"), ("c", "5")]
