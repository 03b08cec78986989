"""Exact top-k inner products by Fagin's threshold algorithm.

The vectors are dealt into blocks.  A block has, for each dimension, its vectors sorted by
their component; these lists are made once and written as one row.  A query walks all lists of a block from its good end at once;
every vector that comes up is scored in full, and the sum of the query's weights times the components at the current
depth bounds every vector not yet met.  The walk ends when that bound is below the kth best score known, so a result is
exact.  Depths double, so that each step works on whole arrays.

Queries are dealt into blocks too.  Each meets one block of vectors first, whose kth best score is its bound in all others:
these give only what reaches it, and end their walks the sooner.  No side is broadcast and no task holds more than a few blocks;
what moves is every block of vectors once, and the blocks of queries once for each block of vectors.

How soon a walk ends depends on the data: in few dimensions, or where a few components make the score, after a small part of
a block; with 64 independent components of equal spread the bound falls below the best scores only when all vectors have been met.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vispark.llm.common import release, staged

BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 512
FIRST_DEPTH = 4
#: Rows of a batch that holds blocks.
BLOCK_ROWS = 4

_HIT = "query_row long, query_id long, vec_id long, score long"
_NO_BOUND = -(2**63)


class SortedLists:
    """A block of vectors with its sorted lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        if order is None:
            by_id = np.lexsort((rows, ids))  # ties of a score go to the smaller id
            rows, ids, vectors = rows[by_id], ids[by_id], vectors[by_id]
            order = np.argsort(vectors, axis=0, kind="stable")  # ascending, one column a dimension
        self.rows, self.ids, self.vectors, self.order = rows, ids, vectors, order
        self.scored = 0

    def to_bytes(self) -> bytes:
        n, dims = self.vectors.shape
        wide = 2 if n == 0 or np.abs(self.vectors).max(initial=0) < 2**15 else 8
        parts = [self.rows.astype("<i8"), self.ids.astype("<i8"), self.vectors.astype(f"<i{wide}"), self.order.astype("<u4" if n > 2**16 else "<u2")]
        return struct.pack("<QQQ", n, dims, wide) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> SortedLists:
        n, dims, wide = struct.unpack_from("<QQQ", data)
        at, out = 24, []
        for kind, count in (("<i8", n), ("<i8", n), (f"<i{wide}", n * dims), ("<u4" if n > 2**16 else "<u2", n * dims)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        rows, ids, vectors, order = out
        return cls(rows, ids, vectors.reshape(n, dims).astype(np.int64), order.reshape(n, dims).astype(np.int64))

    def top(self, query: np.ndarray, own_row: int, k: int, bound: int = _NO_BOUND) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best that reach the bound, by descending score, then id."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        weights, down = query[used], query[used] > 0
        seen = np.zeros(n, bool)
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, at = FIRST_DEPTH, 0
        if not len(used):
            depth = n
        while True:
            depth = min(depth, n)
            for d, falling in zip(used, down):
                column = self.order[:, d]
                seen[column[n - depth : n - at] if falling else column[at:depth]] = True
            if depth == n:
                seen[:] = True
            seen[places] = False
            new = np.flatnonzero(seen)
            seen[places] = True
            new_scores = self.vectors[new] @ query
            self.scored += len(new)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, new_scores])
            rivals = self.rows[places] != own_row
            least = bound
            if np.count_nonzero(rivals) >= k:
                least = max(bound, int(np.partition(scores[rivals], -k)[-k]))
            if depth == n:
                break
            edge = np.where(down, self.order[n - depth, used], self.order[depth - 1, used])
            if int(weights @ self.vectors[edge, used]) < least:
                break
            at, depth = depth, depth * 2
        some = rivals & (scores >= least)
        best = sorted(zip((-scores[some]).tolist(), self.ids[places[some]].tolist()))[:k]
        return [(i, -s) for s, i in best]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def exact_top_k(vectors: DataFrame, k: int = 5, scale: int = 256, query_step: int = 50) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best of every row whose vec_id is divisible by query_step.

    Components become floor(scale * x); a score is an integer inner product.  Candidates are all rows but the query's own.
    Ties go to the smaller vec_id.  Rows with a null vec_id, a null vector or null or non-finite components take no
    part; a shorter vector counts as ending in zeros; repeated rows are separate candidates and queries.  With fewer than k
    candidates all are returned; an empty table gives no rows.
    """
    e = vectors["embedding"]
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(vectors["vec_id"].isNotNull() & e.isNotNull() & ~F.exists(e, bad))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(vectors["vec_id"].cast("long").alias("vec_id"), whole.alias("v"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    n_blocks, n_query_blocks = -(-n // BLOCK_VECTORS) or 1, -(-n_queries // BLOCK_QUERIES) or 1
    dims = dims or 0

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = SortedLists(np.asarray(table.column("row")), np.asarray(table.column("vec_id")), _matrix(table.column("v"), dims))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([block.to_bytes()], pa.binary())], ["block", "lists"])

    def blocks(df: DataFrame, count: int, name: str) -> DataFrame:
        dealt = df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
        return staged(dealt.groupBy("block").applyInArrow(packed, "block int, lists binary"), name, BLOCK_ROWS)

    lists = blocks(rows, n_blocks, "lists")
    asked = blocks(rows.where(is_query), n_query_blocks, "queries").select("block", F.col("lists").alias("queries"))
    release(rows)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_row, query_id, vec_id, score of the best in a block that reach the query's bound, if it has one."""
        for batch in batches:
            for block, queries, bounds in zip(batch.column("lists"), batch.column("queries"), batch.column("bounds")):
                block, queries, out = SortedLists.from_bytes(block.as_py()), SortedLists.from_bytes(queries.as_py()), []
                known = np.frombuffer(bounds.as_py(), "<i8") if bounds.is_valid else np.full(len(queries.rows), _NO_BOUND)
                for row, query_id, query, bound in zip(queries.rows.tolist(), queries.ids.tolist(), queries.vectors, known.tolist()):
                    out += [(row, query_id, i, s) for i, s in block.top(query, row, k, bound)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], [f.split()[0] for f in _HIT.split(", ")])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of queries with the kth best score of each in the one block of vectors it meets first."""
        for batch in batches:
            for number, block, queries in zip(batch.column("block").to_pylist(), batch.column("lists"), batch.column("queries")):
                block, asked = SortedLists.from_bytes(block.as_py()), SortedLists.from_bytes(queries.as_py())
                best = [block.top(q, row, k) for q, row in zip(asked.vectors, asked.rows.tolist())]
                least = np.array([b[-1][1] if len(b) == k else _NO_BOUND for b in best], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([queries.as_py()], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["block", "queries", "bounds"])

    by_block = lists.select(F.col("block").alias("vb"), "lists")
    if n_blocks > 1:
        home = asked.withColumn("vb", F.pmod(F.col("block"), F.lit(n_blocks)))
        met = home.join(by_block, "vb").select("block", "lists", "queries").mapInArrow(bounded, "block int, queries binary, bounds binary")
        asked = staged(met, "bounds", BLOCK_ROWS)
    else:
        asked = asked.withColumn("bounds", F.lit(None).cast("binary"))
    pairs = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(by_block, "vb")
    found = staged(pairs.select("lists", "queries", "bounds").mapInArrow(hits, _HIT), "hits", BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
