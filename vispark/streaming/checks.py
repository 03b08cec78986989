"""State over streams of checks: which requests and results are fresh, and which rows changed a value.

Both need the RocksDB state store (with_state_store sets it).  Events of a key are taken in the order of a column of theirs within a
micro-batch, and micro-batches in theirs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

# Fixed value: boxes that are remembered for one owner.
MAX_KEYS = 1000
#: An owner without events for so long is forgotten.
TTL_MS = 3_600_000
#: The two kinds of events.
REQUEST, RESULT = "request", "result"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that the operators here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def is_fresh(latest: dict, kind: str, box: str | tuple, seq: int, max_keys: int = MAX_KEYS) -> bool:
    """Whether an event counts, given the boxes' latest numbers in the order of their last requests, which it brings up to date.

    A request counts unless a higher number of its box has been seen; it then is its box's latest, and the boxes asked longest ago go if there
    are too many.  A result counts if its number still is the latest: else the text has moved on, or the box is forgotten.
    """
    seen = latest.get(box)
    if kind != REQUEST:
        return seen == seq
    if seen is not None and seen > seq:
        return False
    latest.pop(box, None)
    latest[box] = seq
    while len(latest) > max_keys:
        del latest[next(iter(latest))]
    return True


class _Freshness(StatefulProcessor):
    """An owner's state is one value: the boxes, as JSON of their columns, and their latest numbers, those asked longest ago first."""

    def __init__(self, columns: list[str], boxes: list[str], seq: str, kind: str, order: str, max_keys: int, ttl_ms: int | None):
        self.columns, self.boxes, self.seq, self.kind, self.order, self.max_keys, self.ttl_ms = columns, boxes, seq, kind, order, max_keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "boxes array<string>, seqs array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        latest = dict(zip(*self.latest.get())) if self.latest.exists() else {}
        out = []
        for row in sorted(rows, key=lambda r: r[self.order]):
            box = json.dumps([row[b] for b in self.boxes], default=str)
            fresh = is_fresh(latest, row[self.kind], box, row[self.seq], self.max_keys)
            out.append(Row(**{c: row[c] for c in self.columns}, fresh=fresh))
        self.latest.update((list(latest), list(latest.values())))
        yield from out

    def close(self) -> None:
        pass


def latest_checks(
    stream: DataFrame, owner: str, boxes: Iterable[str], seq: str, kind: str = "kind", order: str = "order", max_keys: int = MAX_KEYS, ttl_ms: int | None = TTL_MS
) -> DataFrame:
    """A stream of requests and results with fresh: whether it still counts (is_fresh).

    owner: who has the boxes (a browser, a tab), the key of the state.  boxes: the columns that name a box, together.  Per owner max_keys
    boxes are remembered, and nothing of one that has been silent for ttl_ms (null: for ever); while it counts, the stream has a batch to do at any time,
    so a query that is to end when the input does (availableNow) must go without.  A null in boxes is a value like others; seq, kind and order must not be null.
    """
    schema = StructType([*stream.schema.fields, StructField("fresh", BooleanType())])
    processor = _Freshness(stream.columns, list(boxes), seq, kind, order, max_keys, ttl_ms)
    return stream.groupBy(owner).transformWithState(processor, schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


class _Changes(StatefulProcessor):
    def __init__(self, columns: list[str], order: list[str], value: str, kind: str):
        self.columns, self.order, self.value, self.kind = columns, order, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"value {self.kind}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        known, last = self.last.exists(), None
        if known:
            last = self.last.get()[0]
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            value = row[self.value]
            if not known or value is None and last is None or value != last:
                yield Row(**{c: row[c] for c in self.columns})
            known, last = True, value
        self.last.update((last,))

    def close(self) -> None:
        pass


def changed_only(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows of a stream whose value differs from their key's row before them, as events.changes has them in batch; order must not be null."""
    processor = _Changes(stream.columns, order, value, dict(stream.dtypes)[value])
    return stream.groupBy(key).transformWithState(processor, stream.schema, "Append", "None")


class WeeklyCounters:
    """Counts by week of a stream, in a folder: a part for each micro-batch, so that one that is written again changes nothing.

    counters.follow(events, ...) starts the stream, counters.table() gives the latest weeks.  compact() adds up the parts of finished
    micro-batches and removes weeks that are too old, which can never be shown again.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], keep_weeks: int = 8):
        self.spark, self.path, self.fields, self.keep_weeks = spark, path, fields, keep_weeks

    def add(self, events: DataFrame, batch: int, ts: str = "ts") -> None:
        """The counts of a micro-batch; the same batch again takes its own place."""
        from vispark.streaming.events import weekly_counts

        if batch > self._done():
            weekly_counts(events, ts, self.fields).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, events: DataFrame, checkpoint: str, ts: str = "ts"):
        """A writer of the stream that adds each micro-batch; start it with a trigger."""
        return events.writeStream.foreachBatch(lambda df, batch: self.add(df, batch, ts)).option("checkpointLocation", checkpoint)

    def _folders(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        whole = lambda n: system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [n for n in names if n.startswith(("batch=", "until=")) and whole(n)]

    def _done(self) -> int:
        """The last micro-batch that is added up, -1 if there is none."""
        return max((int(n[6:]) for n in self._folders() if n.startswith("until=")), default=-1)

    def _parts(self) -> list[str]:
        """What counts now: the last sum, and the batches behind it."""
        done = self._done()
        later = [n for n in self._folders() if n.startswith("batch=") and int(n[6:]) > done]
        return [f"{self.path}/{n}" for n in ([f"until={done}"] if done >= 0 else []) + later]

    def table(self) -> DataFrame:
        """week, fields, n of the latest weeks."""
        from pyspark.sql import Window

        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], ", ".join(["week string", *(f"`{f}` string" for f in self.fields), "n long"]))
        counts = self.spark.read.parquet(*parts).groupBy("week", *self.fields).agg(F.sum("n").alias("n"))
        weeks = counts.select("week").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc("week"))))  # one row a week
        return counts.join(F.broadcast(weeks.where(F.col("_r") <= self.keep_weeks).select("week")), "week", "left_semi")

    def compact(self) -> None:
        """One sum for all finished micro-batches; it counts from the moment that it is whole, and only then the parts go."""
        batches = [int(n[6:]) for n in self._folders() if n.startswith("batch=")]
        done = self._done()
        if not batches or max(batches) <= done:
            return
        self.table().write.mode("overwrite").parquet(f"{self.path}/until={max(batches)}")
        jvm = self.spark.sparkContext._jvm
        system = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for name in [f"batch={b}" for b in batches] + ([f"until={done}"] if done >= 0 else []):
            system.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
