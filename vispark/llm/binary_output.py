"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

One file for each range of doc_id.  A file is a row of zstandard frames, each of one document's ids (a very long
document has several), then a skippable frame with the document index, then the seek table of the public
seekable format: each frame's compressed size, size and checksum (low 32 bits of XXH64), and a footer
of nine bytes.  Any zstandard decoder reads the file as a whole; a reader that knows the table fetches only
the frames of the documents it wants.

Executors write through pyarrow's file systems, under names of their own attempt; the manifest
table names the files that count, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vispark.llm.common import whole_text, write_table
from vispark.llm.tokens import crc32, default_vocabulary, encoder

SKIPPABLE, SEEK_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids of a frame at most; a longer document goes on in the next frame.
FRAME_IDS = 1 << 20
LEVEL = 3

_MANIFEST = "part int, file string, n_docs long, n_tokens long, first_doc long, last_doc long"
_READ = "doc_id long, at long, n_tokens long, ids_crc32 long, ids binary"


def _low_xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents one after another to a binary stream; width: bytes of an id on disk, 2 or 4."""

    def __init__(self, stream, width: int, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard

        self.stream, self.width, self.frame_ids = stream, width, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.first_frames: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.first_frames.append(len(self.frames))
        step = 4 * self.frame_ids
        for at in range(0, max(len(ids), 1), step):
            part = ids[at : at + step]
            if self.width == 2:
                part = np.frombuffer(part, "<u4").astype("<u2").tobytes()
            packed = self.pack.compress(part)
            self.stream.write(packed)
            self.frames.append((len(packed), len(part), _low_xxh64(part)))

    def close(self) -> None:
        known = np.array([d is not None for d in self.doc_ids], "u1")
        index = self.pack.compress(
            struct.pack("<IQ", self.width, len(self.doc_ids))
            + known.tobytes()
            + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
            + np.array(self.counts, "<u8").tobytes()
            + np.array(self.first_frames, "<u4").tobytes()
        )
        self.stream.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0, _low_xxh64(b""))]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class TokenFileReader:
    """Reads documents from a seekable binary stream of TokenFileWriter, checking each frame it opens."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        end = stream.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.checks = table[:, 1], table[:, 2]
        self.ends = np.cumsum(table[:, 0].astype("i8"))
        index = self.unpack.decompress(self._frame(n - 1)[8:])
        self.width, docs = struct.unpack_from("<IQ", index)
        at, known = 12 + docs, np.frombuffer(index, "u1", docs, 12)
        ids = np.frombuffer(index, "<i8", docs, at)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.counts = np.frombuffer(index, "<u8", docs, at + 8 * docs).astype("i8")
        self.first_frames = np.append(np.frombuffer(index, "<u4", docs, at + 16 * docs).astype("i8"), n - 1)
        self.starts = np.cumsum(self.counts) - self.counts

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _frame(self, i: int) -> bytes:
        begin = int(self.ends[i - 1]) if i else 0
        return self._at(begin, int(self.ends[i]) - begin)

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document as little-endian unsigned 32-bit; opens only its frames."""
        out = []
        for i in range(int(self.first_frames[k]), int(self.first_frames[k + 1])):
            part = self.unpack.decompress(self._frame(i)) if self.sizes[i] else b""
            if _low_xxh64(part) != int(self.checks[i]):
                raise ValueError(f"frame {i} fails its checksum")
            out.append(np.frombuffer(part, "<u2").astype("<u4").tobytes() if self.width == 2 else part)
        return b"".join(out)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = 0, cache_words: int | None = None) -> None:
    """Encodes doc_id, text and writes token files and their manifest below path, in ascending doc_id order.

    Null text counts as empty and is written as the end id alone; a null doc_id comes first; rows of one doc_id follow
    each other in the order of their texts' hashes.  Other columns are ignored.  An empty table
    gives an empty manifest.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, part, writer, stream = encoder(vocabulary, cache_words), TaskContext.get().partitionId(), None, None
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if writer is None and batch.num_rows:
                files, folder = fs.FileSystem.from_uri(path)
                files.create_dir(folder, recursive=True)
                stream = files.open_output_stream(f"{folder}/{name}", compression=None)
                writer = TokenFileWriter(stream, 2 if enc.vocab_size <= 1 << 16 else 4)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            stream.close()
            row = [part, name, len(writer.counts), sum(writer.counts), writer.doc_ids[0], writer.doc_ids[-1]]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            names = [f.split()[0] for f in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_table(ordered.mapInArrow(write, _MANIFEST), f"{path}/manifest")


def read_token_files(
    spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None, with_ids: bool = False
) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens, ids_crc32, and ids (binary) if asked for.

    start counts the ids of all documents before it.  doc_ids: a short list of documents; then only files whose range
    holds one are opened, and only those documents' frames are decompressed.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        some = F.lit(False)
        for d in wanted:
            some = some | (F.coalesce("first_doc", F.lit(-(2**63))) <= d) & (F.col("last_doc") >= d)
        files = files.where(some)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, folder = fs.FileSystem.from_uri(path)
                with system.open_input_file(f"{folder}/{name}") as stream:
                    file, rows = TokenFileReader(stream), []
                    for k, doc_id in enumerate(file.doc_ids):
                        if wanted is None or doc_id in wanted:
                            ids = file.ids(k)
                            rows.append((doc_id, base + int(file.starts[k]), len(ids) // 4, crc32(ids), ids if with_ids else None))
                        if len(rows) == 1000 or k + 1 == len(file.doc_ids):
                            kinds = [*[pa.int64()] * 4, pa.binary()]
                            cols = list(zip(*rows)) or [[]] * 5
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "at", "n_tokens", "ids_crc32", "ids"]
                            )
                            rows = []

    n = max(1, manifest.count())
    rows = files.select("file", "base", "part").repartitionByRange(n, "part").select("file", "base").mapInArrow(read, _READ)
    return rows.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
