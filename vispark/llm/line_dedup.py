"""Lines that many documents share, by levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line stripped and with A-Z lower-cased; what is kept of it is the first half of its SHA-256.  Runs are
tables of (key, n), n the number of documents, bucketed and sorted by key.  Documents come in batches.  A batch
counts its own keys, merge-anti-joins the keys that the runs have settled already (n at the threshold: their number
no longer matters), and adds the rest as a run of the lowest level.  Where a level has two runs, they are merged into one of the
next, so a key is rewritten once a level.  Runs have the same buckets, so neither the anti-join nor a merge shuffles them.

In the end one run is left, and its settled keys go.  Of a document, only the places of its lines to drop
move, and its text once, to meet them; the lines between two dropped ones are cut out as slices, so a long text costs
no more than its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vispark.llm.common import MAX_BROADCAST_ROWS, delete_path, release, scratch, settings, staged, whole_text

#: White space that is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
#: A line goes if so many documents have it.
MIN_DOCS = 10
#: Parts of a table that are added to the runs one after the other.
BATCHES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_hash(line: Column) -> Column:
    """16 bytes of the key's SHA-256; null for a line without a key."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.length(bare) > 0, F.unhex(F.substring(F.sha2(lower_ascii(bare), 256), 1, 32)))


class LineRuns:
    """Runs of (key, n) by level, in the folder that driver and executors share; as many buckets as shuffle partitions."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self._paths: dict[str, str] = {}

    def _write(self, counts: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line_run")
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            counts.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self._paths.pop(name))

    def add(self, keys: DataFrame) -> None:
        """keys: key, one row for each line key that a document has; a document of the batch comes in no other."""
        counts = keys.groupBy("key").agg(F.count("*").alias("n"))
        for run in filter(None, self.levels):
            settled = self.spark.table(run).where(F.col("n") >= self.min_docs).select("key")
            counts = counts.join(settled.hint("merge"), "key", "left_anti")
        run, level = self._write(counts), 0
        while level < len(self.levels) and self.levels[level]:
            older = self.levels[level]
            merged = self._merged(older, run)
            self._drop(older), self._drop(run)
            self.levels[level], run, level = None, merged, level + 1
        self.levels[level : level + 1] = [run]

    def _merged(self, older: str, newer: str) -> str:
        a, b = self.spark.table(older), self.spark.table(newer).select("key", F.col("n").alias("_n"))
        both = a.join(b.hint("merge"), "key", "full_outer")
        return self._write(both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")))

    def settled(self) -> DataFrame:
        """key of all lines that min_docs documents have; merges what runs are left into one."""
        runs = [r for r in self.levels if r]
        while len(runs) > 1:
            merged = self._merged(runs[0], runs[1])
            self._drop(runs[0]), self._drop(runs[1])
            runs[:2] = [merged]
        self.levels = runs
        if not runs:
            return self.spark.createDataFrame([], "key binary")
        return self.spark.table(runs[0]).where(F.col("n") >= self.min_docs).select("key")

    def close(self) -> None:
        """Deletes the runs."""
        for name in list(self._paths):
            self._drop(name)
        self.levels = []


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before dropping), n_dropped, kept (the lines that stay, joined by line ends).

    Texts are split at \\n; a null or empty text is one empty line.  Lines whose key is not empty and which min_docs
    documents have lose all their places everywhere; a document counts once, however often it has a line.  Each row is a
    document, also where rows or ids repeat or the id is null.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    id_ = docs["doc_id"].cast("long")
    # Rows that share id and text lose the same lines, so both together name a row well enough.
    rows = docs.select(id_.alias("doc_id"), whole_text(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_hash", F.transform(F.split("text", "\n", -1), line_hash).alias("keys"))
    path = scratch(spark, "line_keys")
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, text_hash long, keys array<binary>, batch int").parquet(path)
    runs = LineRuns(spark, min_docs)
    for k in range(batches):
        some = lines.where(F.col("batch") == k)
        runs.add(some.select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null"))
    frequent = staged(runs.settled(), "frequent_lines")
    runs.close()
    few = frequent.count() <= MAX_BROADCAST_ROWS
    named = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash")]
    places = lines.select(*named, F.posexplode("keys").alias("at", "key")).where("key is not null")
    places = places.join(F.broadcast(frequent) if few else frequent, "key", "left_semi")
    # Repeated rows give the same places again, so a place counts once.
    drops = staged(places.groupBy("_none", "_id", "_hash").agg(F.sort_array(F.collect_set("at")).alias("at")), "line_places")
    release(frequent)
    delete_path(spark, path)
    cut = rows.select("doc_id", *named, F.split("text", "\n", -1).alias("lines")).join(drops, ["_none", "_id", "_hash"], "left")
    n, d = F.size("lines"), F.size("at")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("at", i - 1) + 1)
    between = lambda i: F.slice("lines", begin(i) + 1, F.when(i == d, n).otherwise(F.get("at", i)) - begin(i))
    kept = F.when(F.col("at").isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), d), between)))
    return cut.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("at").isNotNull(), d), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
