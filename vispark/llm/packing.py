"""Best-fit packing by hierarchical residual packing.

Each partition encodes its documents, cuts the longer ones, and packs the pieces best-fit, longest first.
Full bins are finished; the underfull ones go on as items of their own, from sixteen parts to one, and
are packed best-fit again, until one part is left.  A bin carries its pieces (never more than its length), so no join
puts them together at the end.

After a best-fit pass no two underfull bins of a part fit together, so at most one is filled up to the half.  Where sixteen
parts meet, sixteen such bins are all that can be put into others, and no more than sixteen others can take them in; the
emptiest can do so if any can.  So a part passes on its PASSED emptiest bins and the rest is finished: what reaches
one task are sixteen times PASSED bins, however many documents or parts there are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vispark.llm.common import returning, scratch, whole_text, write_table
from vispark.llm.tokens import crc32, default_vocabulary, encoder

#: Parts packed together in a round.
FAN_IN = 16
#: Underfull bins that a part passes on, the emptiest: four times as many as its round could fill.
PASSED = 4 * FAN_IN
#: Items that a partition packs at once.
BLOCK = 100_000

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = pa.schema([("bin", pa.int64()), ("part", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("pieces", pa.list_(_PIECE))])
_BIN_SQL = (
    "bin long, part long, fill int, done boolean, "
    "pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into lengths: longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def cut_document(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: all of the full size but the first, which takes the rest."""
    n = len(ids) // 4
    first = (n - 1) % size + 1 if n else 0
    starts = [0, *range(first, n, size)]
    return [(a, b - a, crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, [*starts[1:], n])]


def _repacked(
    items: list[tuple[int, list]], size: int, near: int, part: int, to: int, serial: int, passed: int | None = PASSED
) -> Iterator[tuple]:
    """Rows of _BIN from items (fill, pieces): finished bins, and those that go on to part `to`.

    passed: so many of the underfull bins go on, the emptiest; None: all.
    """
    bins = [(sum(items[i][0] for i in b), [p for i in b for p in items[i][1]]) for b in best_fit([f for f, _ in items], size)]
    open_bins = sorted((b for b in bins if b[0] < near), key=lambda b: b[0])
    going = open_bins[:passed]
    for done, some in ((True, [b for b in bins if b[0] >= near]), (True, open_bins[len(going) :]), (False, going)):
        for fill, pieces in some:
            yield (part << 32) + serial, to, fill, done, pieces
            serial += 1


def _batches(rows: Iterator[tuple], n: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _BIN)], schema=_BIN)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _BIN)], schema=_BIN)


def pack_documents(
    docs: DataFrame, length: int = 1024, vocabulary: str | None = None, end_id: int = 2, nearly_full: int | None = None, cache_words: int | None = None
) -> DataFrame:
    """Packs doc_id, text: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document's ids get the end id behind them; null text counts as empty and is the end id alone.  A document longer
    than length is cut into pieces of that length, its first piece taking the rest.  nearly_full:
    fill from which a bin is finished (default: full but for 1 in 64).  cache_words: of the encoder.  Repeated rows and null doc_ids are packed like any
    other; other columns are ignored; an empty table gives no rows.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    end, near = struct.pack("<I", end_id), nearly_full or length - length // 64
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def bins() -> Iterator[tuple]:
            enc, part = encoder(vocabulary, cache_words), TaskContext.get().partitionId()
            items: list[tuple[int, list]] = []
            serial, limit = 0, BLOCK
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for k, (start, n, crc) in enumerate(cut_document(enc.encode(text.as_py()) + end, length)):
                        piece = (doc_id, k, start, n, crc)
                        if n == length:
                            yield (part << 32) + serial, part, n, True, [piece]
                            serial += 1
                        else:
                            items.append((n, [piece]))
                if len(items) >= limit:
                    again = []
                    for row in _repacked(items, length, near, part, part, serial, None):
                        if row[3]:
                            yield row
                        else:
                            again.append((row[2], row[4]))
                        serial += 1
                    items, limit = again, max(BLOCK, 2 * len(again))
            yield from _repacked(items, length, near, part, part // FAN_IN, serial)

        return _batches(bins())

    def later_round(last: bool, round_no: int):
        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            items = [(r["fill"], [tuple(p.values()) for p in r["pieces"]]) for r in table.sort_by("bin").to_pylist()]
            made = list(_repacked(items, length, near, part + (round_no << 24), part // FAN_IN, 0, 0 if last else PASSED))
            return pa.Table.from_batches(_batches(iter(made)), _BIN)

        return merge

    path = scratch(spark, "packing")
    made = [write_table(rows.mapInArrow(returning(first_round), _BIN_SQL), f"{path}/0")]
    round_no, parts = 0, (made[0].agg(F.max("part")).first()[0] or 0) + 1
    while True:
        round_no += 1
        going = made[-1].where("not done").groupBy("part").applyInArrow(later_round(parts == 1, round_no), _BIN_SQL)
        made.append(write_table(going, f"{path}/{round_no}"))
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
    everything = made[0].where("done")
    for more in made[1:]:
        everything = everything.unionByName(more.where("done"))
    lengths = F.transform("pieces", lambda p: p["length"])
    pieces = everything.select(F.col("bin").alias("sequence_id"), lengths.alias("lengths"), F.posexplode("pieces").alias("k", "p"))
    offset = F.aggregate(F.slice("lengths", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, n: a + n)
    return pieces.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", offset.cast("int").alias("offset"))
