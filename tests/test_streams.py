"""Streams against the same rows in batch, or plain Python."""

from __future__ import annotations

import datetime
import random
import time

import pytest

from vispark.streaming import checks
from vispark.streaming import events as ev


def streamed(spark, batches, schema, folder):
    """A stream that reads one batch of rows after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        for f in (folder / "in").glob("part-*"):
            f.rename(folder / "in" / f"{i:03d}.parquet")
        for f in (folder / "in").glob("[_.]*"):
            f.unlink()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def run(stream, name, folder, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert not query.isActive and query.exception() is None
    return query


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = {k: spark.conf.get(k) for k in (name, "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield checks.with_state_store(spark)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fresh_checks(rocks, tmp_path):
    dice, rows, seqs = random.Random(2), [], {}
    for i in range(600):
        owner, box = dice.choice("ab"), (dice.choice([None, 1, 2]), dice.choice(["x", "y", "z", "w"]))
        top = seqs.get((owner, box), 0)
        kind = dice.choice([checks.REQUEST, checks.RESULT])
        seq = dice.choice([top, top + 1, max(0, top - 1)])
        seqs[owner, box] = max(top, seq)
        rows.append((i, owner, *box, kind, seq, f"text {i}"))
    latest, want = {"a": {}, "b": {}}, {}
    for i, owner, tab, box, kind, seq, _ in rows:
        want[i] = checks.is_fresh(latest[owner], kind, (tab, box), seq, 5)
    schema = "order long, owner string, tab int, box string, kind string, seq long, text string"
    shuffled = [dice.sample(rows[k : k + 200], 200) for k in range(0, 600, 200)]
    out = checks.latest_checks(streamed(rocks, shuffled, schema, tmp_path), "owner", ["tab", "box"], "seq", max_keys=5, ttl_ms=None)
    run(out, "fresh", tmp_path)
    got = {r.order: r.fresh for r in rocks.table("fresh").collect()}
    assert got == want and len(set(want.values())) == 2
    assert all(r.text == f"text {r.order}" for r in rocks.table("fresh").collect())


def test_an_owner_is_forgotten(rocks, tmp_path):
    schema = "order long, owner string, tab int, box string, kind string, seq long"
    stream = streamed(rocks, [[(0, "a", 1, "x", checks.REQUEST, 5), (1, "a", 1, "x", checks.RESULT, 5)], [(2, "a", 1, "x", checks.RESULT, 5)]], schema, tmp_path)
    out = checks.latest_checks(stream, "owner", ["tab", "box"], "seq", ttl_ms=1)
    query = out.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "cp")).start()
    begun = time.time()
    while rocks.table("forgotten").count() < 3 and time.time() - begun < 90:
        time.sleep(0.5)
    query.stop()
    assert {r.order: r.fresh for r in rocks.table("forgotten").collect()} == {0: True, 1: True, 2: False}


def test_freshness_by_the_rules():
    latest: dict = {}
    ask = lambda box, seq: checks.is_fresh(latest, checks.REQUEST, (box,), seq)
    answer = lambda box, seq: checks.is_fresh(latest, checks.RESULT, (box,), seq)
    assert ask("o", 3) and not ask("o", 2) and ask("o", 3) and answer("o", 3) and not answer("o", 2)
    assert ask("p", 1) and answer("o", 3)  # another box does not matter
    assert ask("o", 4) and not answer("o", 3)  # the text has moved on
    for i in range(1100):
        assert ask(f"k{i}", 1)
    assert len(latest) == 1000 and not answer("o", 4) and ask("o", 1)


def test_changes_of_a_stream(rocks, tmp_path):
    dice = random.Random(3)
    rows = [(i, dice.choice("ab"), dice.choice(["x", "x", "y", None])) for i in range(200)]
    schema = "n long, k string, v string"
    out = checks.changed_only(streamed(rocks, [dice.sample(rows[k : k + 100], 100) for k in range(0, 200, 100)], schema, tmp_path), "k", ["n"], "v")
    run(out, "changes", tmp_path)
    want = ev.changes(rocks.createDataFrame(rows, schema), "k", ["n"], "v")
    assert sorted(r.n for r in rocks.table("changes").collect()) == sorted(r.n for r in want.collect())


def test_bursts_of_a_stream(spark, tmp_path):
    begin, dice = datetime.datetime(2024, 1, 1), random.Random(5)
    at, rows = begin, []
    for i in range(120):
        at += datetime.timedelta(minutes=dice.choice([1, 2, 30]))
        rows.append((i, dice.choice("ab"), at))
    end = (999, "end", at + datetime.timedelta(days=2))
    schema = "id long, k string, ts timestamp"
    stream = streamed(spark, [rows[k : k + 40] for k in range(0, 120, 40)] + [[end], [(1000, "a", begin), (1001, "end", end[2])]], schema, tmp_path)
    query = run(ev.debounce(stream, "k", "ts", "10 minutes", "id", late="1 hour"), "bursts", tmp_path)
    want = ev.debounce(spark.createDataFrame(rows, schema), "k", "ts", "10 minutes", "id", late="1 hour")
    assert sorted(tuple(r) for r in spark.table("bursts").collect()) == sorted(tuple(r) for r in want.collect())
    assert ev.late_rows(query) == 1


def test_weekly_counters(spark, tmp_path):
    weeks = [datetime.datetime(2024, 1, 3) + datetime.timedelta(weeks=i) for i in range(9)]
    schema = "ts timestamp, field string, tag string"
    batches = [[(w, "shown", "s-x"), (w, "shown", "s-x"), (w, "accepted", None)] for w in weeks]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda c: sorted((r.week, r.field, r.tag or "", r.n) for r in c.table().collect())
    counters = checks.WeeklyCounters(spark, str(tmp_path / "w"), ["field", "tag"])
    assert counters.table().count() == 0
    counters.follow(streamed(spark, batches[:8], schema, tmp_path), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    first = rows(counters)
    assert len(first) == 16 and sum(n for *_, n in first) == 24
    counters.add(frame(batches[3]), 3)  # a replayed batch
    assert rows(counters) == first
    counters.compact()
    counters.compact()
    counters.add(frame(batches[3]), 3)
    assert rows(counters) == first and len(counters._folders()) == 1
    counters.add(frame(batches[8]), 8)  # a ninth week
    assert len(rows(counters)) == 16 and rows(counters)[0][0] == "2024-W02"
    assert rows(counters) == sorted((r.week, r.field, r.tag or "", r.n) for r in ev.weekly_counts(frame([r for b in batches for r in b]), "ts", ["field", "tag"], 8).collect())
    counters.add(frame(batches[0]), 9)  # too old
    counters.compact()
    assert len(rows(counters)) == 16
