"""What the operators of this subpackage share: the scratch folder, stages on disk, rows by their marks, word and space classes."""

from __future__ import annotations

import ctypes
import functools
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of white space, as the query contracts define it.
SPACES = r"[\x20\x09-\x0D]+"
#: Runs of anything else.
WORDS = r"[^\x20\x09-\x0D]+"
#: Used only on a single machine whose session names no spark.checkpoint.dir, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/vispark"
#: Rows of a table that is broadcast, at most; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; on a cluster, spark.checkpoint.dir must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (dots written as __) for a while; afterwards they are as they were."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, path: str, batch_rows: int = 256) -> DataFrame:
    """Writes the rows and reads them back; the shuffle files that made them go with the write.

    batch_rows: rows of an Arrow batch at most, as a single text may be megabytes long.
    """
    spark = df.sparkSession
    with settings(
        spark,
        spark__sql__execution__arrow__maxRecordsPerBatch=str(batch_rows),
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
    ):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, batch_rows: int = 256) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    table = write_table(df, path, batch_rows)
    _PATHS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that no later result reads."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: whatever their names, they clash with none beside it."""
    return F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in df.columns])


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df for a broadcast if it has MAX_BROADCAST_ROWS rows at most, else as it is.  df: a staged table of short rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def keep_marked(docs: DataFrame, marks: DataFrame, text_key: Column) -> DataFrame:
    """The rows of docs that marks keeps, with all their columns.

    marks has one row per row of docs: doc_id, text_key, kept, and once if of the rows that share both keys one is
    kept at most.  text_key: the same key from docs.  Rows are told apart by both (a null doc_id is one of its own); of
    those that share both, as many stay as marks keeps.  Only the keys with something to drop move, and the
    documents not at all if those keys are few enough for a broadcast.
    """
    once = F.max("once") if "once" in marks.columns else F.lit(False)
    n_kept = F.when(once, F.least(F.count_if("kept"), F.lit(1))).otherwise(F.count_if("kept"))
    counts = marks.groupBy(marks["doc_id"].isNull().alias("_k0"), F.coalesce("doc_id", F.lit(0)).alias("_k1"), F.col("text_key").alias("_k2"))
    drops = staged(counts.agg(F.count("*").alias("_all"), n_kept.alias("_kept")).where("_kept < _all"), "drops")
    id_ = docs["doc_id"].cast("long")
    rows = docs.select(whole_row(docs).alias("row"), id_.isNull().alias("_k0"), F.coalesce(id_, F.lit(0)).alias("_k1"), text_key.alias("_k2"))
    keys = ["_k0", "_k1", "_k2"]
    out = rows.join(maybe_broadcast(drops.select(*keys)), keys, "left_anti").select("row.*")
    some = drops.where("_kept > 0")
    if not some.isEmpty():
        order = Window.partitionBy(*keys).orderBy(F.to_json("row"))
        again = rows.join(maybe_broadcast(some.select(*keys, "_kept")), keys).withColumn("_n", F.row_number().over(order))
        out = out.unionByName(again.where("_n <= _kept").select("row.*"))
    return out


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over a task's batches, which gives freed memory back to the system in the end: the worker goes on to other tasks."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim is not None:
                trim(0)

    return whole
