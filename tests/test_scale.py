"""Operators that must hold for one very large document, group or table, against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from vispark.functions.text import unit_hash
from vispark.operators import issues, metrics, sampling

ISSUE = "doc_id long, start int, end int, confidence double, source string, suggestion string"


def spans(n, docs, length, seed):
    dice = random.Random(seed)
    out = set()
    for _ in range(n):
        start = dice.randrange(length)
        out.add((dice.choice(docs), start, start + dice.choice([0, 1, 3, 40, 9000]), dice.choice([0.5, 0.9]), dice.choice(["rule", "model"]), dice.choice("xy")))
    return sorted(out)


def kept(rows):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], -r[2], -r[3], r[4], r[5])):
        if r[1] >= last.get(r[0], -1):
            last[r[0]] = r[2]
            out.append(r)
    return sorted(out)


def test_overlaps_of_many_issues(spark):
    rows = spans(4000, [1, 2], 60_000, 1) + [(3, i * 3, i * 3 + 2, 0.9, "rule", "x") for i in range(20_000)] + [(4, 7, 7, 0.9, "rule", "x"), (4, 7, 7, 0.9, "rule", "x")]
    begun = time.time()
    got = issues.dedupe_issues(spark.createDataFrame(rows, ISSUE)).collect()
    assert sorted(map(tuple, got)) == kept(rows)
    assert time.time() - begun < 60
    assert issues.dedupe_issues(spark.createDataFrame([], ISSUE)).count() == 0


def test_overlaps_by_bins(spark):
    rows = spans(1500, [1, 2, 3], 30_000, 2)
    df = spark.createDataFrame(rows, ISSUE)
    rules, model = [r for r in rows if r[4] == "rule"], [r for r in rows if r[4] == "model"]
    want = rules + [m for m in model if not any(m[0] == r[0] and m[1] < r[2] and r[1] < m[2] for r in rules)]
    assert sorted(map(tuple, issues.merge_rule_first(df.where("source = 'rule'"), df.where("source = 'model'")).collect())) == sorted(want)
    ranges = [(d, k * 3000, k * 3000 + w) for d in (1, 2) for k in range(10) for w in (0, 5, 2000, 9000)]
    got = issues.hits_in_ranges(df.select("doc_id", "start"), spark.createDataFrame(ranges, "doc_id long, begin int, stop int")).collect()
    found = []
    for d, start, *_ in rows:
        hits = [(d, start, b, e) for x, b, e in ranges if x == d and b <= start < e]
        found += hits or [(d, start, None, None)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(found, key=key)


def test_a_document_of_many_spans(spark):
    many = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("source"), F.lit("x").alias("suggestion"))
    model = many.where("start % 30 = 0").withColumn("start", F.col("start") + F.when(F.col("start") % 60 == 0, 5).otherwise(0)).withColumn("end", F.col("start") + 3)
    assert issues.merge_rule_first(many, model).count() == 1_000_000 + 166_667


@pytest.mark.parametrize("at_cut", [10_000, 2])
def test_samples_by_threshold(spark, monkeypatch, at_cut):
    monkeypatch.setattr(sampling, "AT_CUT", at_cut)
    rows = spark.range(700).withColumn("key", F.col("id") % 650)
    order = [r.id for r in rows.withColumn("u", F.floor(unit_hash(13, F.col("key")) * float(2**32))).orderBy("u", "key", "id").collect()]
    keys = {r.id: r.key for r in rows.collect()}
    for n in (0, 1, 13, 350, 699, 700):
        got = [r.key for r in sampling.sample_rows(rows, "key", n).collect()]
        assert sorted(got) == sorted(keys[i] for i in order[:n])
    with pytest.raises(ValueError):
        sampling.sample_rows(rows, "key", 701)
    plan = sampling.sample_rows(rows, "key", 600)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


def test_order_statistics(spark):
    dice = random.Random(5)
    groups = {g: [dice.choice([1.5, 2.0, dice.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 997), (None, 40))}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("d", None)]
    picks = {f"{rule}{i}": (rule, q) for rule in ("linear", *metrics.INDEX_RULES) for i, q in enumerate((0.0, 0.5, 0.9, 0.95, 0.99))}
    out = metrics.order_statistics(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], picks)
    got = {r.g: r for r in out.where("g is not null").collect()}
    for g, values in groups.items():
        if g is None:
            continue
        v, n = sorted(values), len(values)
        assert got[g].n == n
        for name, (rule, q) in picks.items():
            if rule == "linear":
                at = (n - 1) * q
                low = int(at)
                want = v[low] * (1 - (at - low)) + v[min(low + 1, n - 1)] * (at - low)
            else:
                want = v[{"floor": min(n - 1, int(n * q)), "before": int(n * q) - 1, "ceil": max(-(-int(n * q * 1e9) // 10**9) - 1, 0) if (n * q) % 1 else max(int(n * q) - 1, 0)}[rule]]
            assert got[g][name] == pytest.approx(want, abs=1e-12), (g, name)
    assert set(got) == {"a", "b", "c"}
    assert out.where("g is null").first().n == 40
