"""Near duplicates by a grouped prefix join on word shingles: Jaccard similarity of 0.8 or more.

Sets are ordered by (frequent, hash).  Two sets of that similarity share an element of their prefixes, the first
n - ceil(0.8 n) + 1 elements.  Documents with equal sets are one class; classes with equal prefix and
size are one group, and only groups go into the postings.  A posting keeps the element before it: two groups with
the same one have met there already, so a pair comes up once for each stretch they share, not for each element.

What counts is which documents are linked with one another, directly or in steps.  So of a long posting list only
the pairs with a few pivots are verified at first; after that, only pairs whose ends are in different
components can matter.  These are compared by block: sizes, places in the prefix and sketches (how many
elements fall into each bin) bound the similarity, and what the bounds leave is verified on whole texts.  The same holds for
the members of groups.  No candidate is dropped otherwise, and no group of copies is expanded into its pairs.

Frequent elements are those that a first pass over all documents finds often.  The list only decides the order, and which
posting lists are dealt to several tasks; it never decides the result, so it may have a fixed length.

An element is a 64-bit hash of its five words.  Among k distinct shingles of the corpus, the chance that any two share a
hash is about k * k / 2**65: under one in a million for 5 million shingles, and for any one document of 1,000 shingles
the chance that its set size is wrong stays under 3e-14.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.llm.common import keep_marked, maybe_broadcast, release, returning, staged, whole_text
from vispark.llm.components import components
from vispark.llm.shingles import digest, shingle_set

WORDS_PER_SHINGLE, PERCENT = 5, 80
#: Frequent elements kept at most (16 bytes each); the most frequent ones.
MAX_FREQUENT = 1_000_000
#: An element is frequent from so many documents, counted where a partition has LOCAL_COUNT of them.
MIN_FREQUENT, LOCAL_COUNT = 12, 3
#: Elements that a task counts at a time (8 bytes each).
COUNT_WINDOW = 2_000_000
#: Posting lists up to this length are paired at once.
SHORT_LIST = 24
#: The list of an element that more documents have is dealt to several tasks, about so many entries to each.
LIST_PART = 100_000
#: Postings in a bucket, about.
BUCKET_POSTINGS = 400_000
#: Bins of a sketch: a power of two, about one for every two elements, between these.
MIN_BINS, MAX_BINS = 64, 4096
#: Entries of a long list that are compared with as many others in one group.
BLOCK = 2048

_SIG_SQL = "doc_id long, text_key long, n long, set_key binary, group_key binary, prefix binary, sketch binary"
_SIG = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("set_key", "group_key", "prefix", "sketch")]
)
_POSTING = np.dtype([("token", "<u8"), ("prev", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("at", "<u4")])
#: kind 0: a pair to verify; 1: an entry of a long list; 2: the pivot of a part of a list that has several.
_MET_SQL = "kind int, list long, a long, b long, prev long, at int"
_MET = pa.schema([("kind", pa.int32()), ("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("prev", pa.int64()), ("at", pa.int32())])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall into each bin (255 at most), by their upper bits; the number of bins goes with the size.

    Two sets differ in as many elements at least as their sketches do, also if neighbouring bins of the longer are added up.
    """
    bins = min(MAX_BINS, max(MIN_BINS, 1 << (len(elements) // 2).bit_length()))
    at = (elements >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=bins), 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many elements are in one set only, from the sketches of both."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    bins = min(len(a), len(b))
    return int(np.abs(a.reshape(bins, -1).sum(1) - b.reshape(bins, -1).sum(1)).sum())


class ElementCounter:
    """Counts of the elements that come up more than once within a window, in two sorted arrays."""

    def __init__(self, window: int = COUNT_WINDOW):
        self.values, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held, self.size = np.empty(window, np.uint64), 0

    def add(self, elements: np.ndarray) -> None:
        for at in range(0, len(elements), len(self.held)):
            part = elements[at : at + len(self.held)]
            if self.size + len(part) > len(self.held):
                self.fold()
            self.held[self.size : self.size + len(part)] = part
            self.size += len(part)

    def fold(self) -> None:
        new = self.held[: self.size]
        new.sort()
        self.counts += np.searchsorted(new, self.values, "right") - np.searchsorted(new, self.values, "left")
        again, more = np.unique(new[1:][new[1:] == new[:-1]], return_counts=True)
        at = np.searchsorted(self.values, again)
        fresh = np.ones(len(again), bool)
        inside = at < len(self.values)
        fresh[inside] = self.values[at[inside]] != again[inside]
        values = np.concatenate([self.values, again[fresh]])
        order = np.argsort(values, kind="stable")
        self.values, self.counts = values[order], np.concatenate([self.counts, more[fresh] + 1])[order]
        self.size = 0


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the elements that many documents have, and those whose lists are long enough for several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ElementCounter()
        for batch in batches:
            for text in batch.column(0):
                seen.add(shingle_set(text.as_py(), WORDS_PER_SHINGLE))
        seen.fold()
        often = seen.counts >= LOCAL_COUNT
        yield pa.RecordBatch.from_arrays([pa.array(seen.values[often].view(np.int64)), pa.array(seen.counts[often])], ["token", "docs"])

    found = staged(docs.select(whole_text(docs).alias("text")).mapInArrow(returning(count), "token long, docs long"), "counts")
    total = found.groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_FREQUENT)
    rows = total.orderBy(F.desc("docs"), "token").limit(MAX_FREQUENT).toArrow()
    release(found)
    tokens = np.asarray(rows.column("token").combine_chunks()).view(np.uint64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], np.asarray(rows.column("docs").combine_chunks())[order]
    hot = counts > LIST_PART
    return tokens, np.stack([tokens[hot], (-(-counts[hot] // LIST_PART)).astype(np.uint64)])


def _signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(frequent)  # MAX_FREQUENT * 8 bytes at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = known.value
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), WORDS_PER_SHINGLE)
                n = len(s)
                ordered = s
                if len(often) and n:
                    late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    if late.any():
                        ordered = np.concatenate([s[~late], s[late]])
                prefix = ordered[: prefix_length(n)].tobytes()
                rows.append((doc_id, key, n, digest(s.tobytes()), digest(struct.pack("<q", n) + prefix), prefix, sketch(s)))
            columns = zip(*rows) if rows else [[]] * len(_SIG)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIG)], schema=_SIG)

    return staged(_keyed(docs).mapInArrow(returning(sign), _SIG_SQL), "signatures")


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _meet(token: int, part: np.ndarray, several: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of _MET for one posting list, or a part of one: pairs to verify, and the entries of a long list."""
    order = np.lexsort((part["gid"], part["n"]))
    gid, n, prev = part["gid"][order], part["n"][order].astype(np.int64), part["prev"][order]
    size, before = len(gid), part["at"][order].astype(np.int64)

    def pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        # of a similar pair, what comes before its first common element is in one set only, and such are a ninth of both at most
        ok = (9 * (before[i] + before[j]) <= n[i] + n[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * PERCENT) & ((prev[i] != prev[j]) | (prev[i] == 0)) & (gid[i] != gid[j])
        a, b = gid[i][ok], gid[j][ok]
        none = np.zeros(len(a), np.int64)
        return none, none, np.minimum(a, b), np.maximum(a, b), none, none

    if size <= SHORT_LIST and not several:
        yield pairs(*np.triu_indices(size, 1))
        return
    # Of near copies, the one with the fewest rare elements before this one is nearest to all others: the pivot.  A second one
    # comes from the entries that met before, if there are any, so that only the others meet it here.
    early = np.lexsort((gid, before))
    kinds, at, often = np.unique(prev, return_inverse=True, return_counts=True)
    most = int(often.argmax())
    pivots = {int(early[0])}
    if often[most] > 1 and kinds[most] != 0:
        pivots.add(int(early[at[early] == most][0]))
    for p in pivots:
        yield pairs(np.full(size, p), np.arange(size))
    name, zero = np.full(size, token, np.uint64).view(np.int64), np.zeros(size, np.int64)
    yield np.ones(size, np.int64), name, gid, zero, prev.view(np.int64), before
    if several:
        one = early[:1]
        yield np.full(1, 2), name[:1], gid[one], zero[:1], zero[:1], before[one]


def _meetings(groups: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Posting lists of the groups' prefixes, and what meets in them.  hot: elements, and to how many tasks each is dealt."""
    known = groups.sparkSession.sparkContext.broadcast(hot)  # elements with more than LIST_PART documents only

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = known.value
        for batch in batches:
            made = []
            for gid, n, prefix in zip(*(batch.column(i).to_pylist() for i in range(3))):
                token = np.frombuffer(prefix, "<u8")
                p = np.empty(len(token), _POSTING)
                p["token"], p["gid"], p["n"], p["at"] = token, gid, n, np.arange(len(token))
                p["prev"][1:] = token[:-1]
                p["prev"][:1] = 0
                made.append(p)
            if not made:
                continue
            entries = np.concatenate(made)
            to = entries["token"] % np.uint64(buckets)
            if len(names):
                at = np.minimum(np.searchsorted(names, entries["token"]), len(names) - 1)
                mine = np.flatnonzero(names[at] == entries["token"])
                to[mine] = (to[mine] + entries["gid"][mine].astype(np.uint64) % parts[at[mine]]) % np.uint64(buckets)
            to = to.astype(np.int64)
            order = np.argsort(to, kind="stable")
            entries, to = entries[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            firsts = np.concatenate([[0], cuts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[firsts]), pa.array([p.tobytes() for p in np.split(entries, cuts)], pa.binary())], ["bucket", "postings"]
            )

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(v.as_py() for batch in batches for v in batch.column("postings"))
        entries = np.frombuffer(raw, _POSTING)
        order = np.argsort(entries["token"], kind="stable")
        token = entries["token"][order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        several = np.isin(token[edges[:-1]], known.value[0])
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for at in np.flatnonzero((np.diff(edges) > 1) | several):
            for made in _meet(int(token[edges[at]]), entries[order[edges[at] : edges[at + 1]]], bool(several[at])):
                held.append(made)
                rows += len(made[0])
            if rows > 50_000:
                yield _met(held)
                held, rows = [], 0
        yield _met(held)

    posted = groups.select("gid", "n", "prefix").mapInArrow(returning(post), "bucket long, postings binary")
    return staged(posted.groupBy("bucket").applyInArrow(meet, _MET_SQL), "meetings", batch_rows=2000)


def _met(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held)] if held else [np.empty(0, np.int64)] * len(_MET)
    pair = np.flatnonzero(columns[0] == 0)
    if len(pair):  # the same pair often meets again in a bucket
        _, first = np.unique(np.stack([columns[2][pair], columns[3][pair]]), axis=1, return_index=True)
        chosen = np.sort(np.concatenate([np.flatnonzero(columns[0]), pair[first]]))
        columns = [c[chosen] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _MET)], schema=_MET)


def _possible(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sketches leave a similarity of 0.8 possible: the sets differ in a ninth of both sizes at most."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [9 * least_difference(x.as_py(), y.as_py()) <= t for x, y, t in zip(batch.column("x"), batch.column("y"), batch.column("total").to_pylist())]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    side = lambda c, s: classes.select(F.col("nid").alias(c), F.col("sketch").alias(s), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("total"))
    return staged(both.mapInArrow(returning(compare), "a long, b long"), "possible")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class numbers whose sets are similar enough, from their whole texts; as u, v."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    first = F.coalesce("first.doc_id", F.lit(0)).alias("_id")
    needed = staged(classes.join(needed, "nid", "left_semi").select("nid", "set_key", first, F.col("first.text_key").alias("text_key")), "needed")
    texts = _keyed(docs).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "text_key", "text")
    texts = texts.join(maybe_broadcast(needed), ["_id", "text_key"]).select("nid", "set_key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                elements = shingle_set(text.as_py(), WORDS_PER_SHINGLE).tobytes()
                if digest(elements) == key:
                    rows.append((nid, elements))
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["nid", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                good.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])

    found = staged(texts.mapInArrow(returning(sets), "nid long, elements binary"), "elements")
    elements = found
    if found.count() > needed.count():  # repeated rows
        elements = found.dropDuplicates(["nid"])
    # a pair brings one set to the task that has the other
    left = pairs.join(elements.select(F.col("nid").alias("b"), F.col("elements").alias("y")), "b")
    both = left.join(elements.select(F.col("nid").alias("a"), F.col("elements").alias("x")), "a").select("a", "b", "x", "y")
    links = staged(both.mapInArrow(returning(compare), "u long, v long"), "links")
    release(found, needed)
    return links


_LISTED = ("list", "nid", "n", "prev", "at", "comp", "sketch")


def block_pairs(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of class numbers that may be similar: of one list and different components, one at least outside the main one.

    rows: left and right (which side of the group an entry is on; both if it is compared with itself), rest, and
    nid, n, prev, at, comp, sketch of one group's entries.
    """
    col = {c: np.asarray(rows.column(c).combine_chunks()) for c in ("nid", "n", "prev", "at", "comp", "rest", "left", "right")}
    sketches = rows.column("sketch").to_pylist()
    bins = np.array([len(s) for s in sketches])
    own = col["left"] & col["right"]
    out = []
    by_bins = {}
    for b in np.unique(bins):
        at = np.flatnonzero((bins == b) & col["right"])
        at = at[np.argsort(col["n"][at], kind="stable")]
        wide = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), b).astype(np.int16)
        by_bins[int(b)] = at, col["n"][at], wide
    for i in np.flatnonzero(col["left"] & col["rest"]):
        b, n = int(bins[i]), int(col["n"][i])
        mine = np.frombuffer(sketches[i], np.uint8).astype(np.int16)
        for other in (b // 2, b, b * 2):
            if other not in by_bins:
                continue
            at, sizes, wide = by_bins[other]
            low, high = np.searchsorted(sizes, -(-n * PERCENT // 100)), np.searchsorted(sizes, n * 100 // PERCENT, "right")
            at = at[low:high]
            ok = (col["comp"][at] != col["comp"][i]) & (9 * (col["at"][at] + col["at"][i]) <= sizes[low:high] + n)
            ok &= (col["prev"][at] != col["prev"][i]) | (col["prev"][i] == 0)
            ok &= ~(own[at] & col["rest"][at] & (col["nid"][at] <= col["nid"][i]))  # such a pair comes up from its other end
            some = np.flatnonzero(ok)
            if not len(some):
                continue
            theirs = wide[low:high][some]
            if other > b:
                theirs = theirs.reshape(len(some), b, 2).sum(2, dtype=np.int16)
            ours = mine.reshape(other, 2).sum(1, dtype=np.int16) if other < b else mine
            near = 9 * np.abs(theirs - ours).sum(1, dtype=np.int64) <= sizes[low:high][some] + n
            if near.any():
                them = col["nid"][at[some[near]]]
                me = np.full(len(them), col["nid"][i])
                out.append((np.minimum(me, them), np.maximum(me, them)))
    return out


def _residual(lists: DataFrame) -> DataFrame:
    """Rows of _LISTED -> pairs (a, b) of a list that are in different components and may be similar.

    All but the entries of a list's largest component are compared with all entries.  A longer list goes in blocks: each block
    outside the main component meets each block of the list once.
    """
    by_size = lists.groupBy("list", "comp").agg(F.count("*").alias("size"))
    main = by_size.groupBy("list").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("kinds"))
    main = main.where("kinds > 1").select("list", F.col("top.comp").alias("main"), F.col("top.size").alias("in_main"), "all")
    main = staged(main, "main")
    entries = lists.join(maybe_broadcast(main), "list").withColumn("rest", F.col("comp") != F.col("main"))
    block = lambda c: F.ceil(c / F.lit(float(BLOCK)))
    spread = F.when(F.col("all") <= BLOCK, F.lit(1)).otherwise(block(F.col("all") - F.col("in_main"))).cast("long")
    whole = F.when(F.col("all") <= BLOCK, F.lit(0)).otherwise(block(F.col("in_main"))).cast("long")
    entries = entries.withColumn("nr", spread).withColumn("nm", whole)
    hashed = lambda c: F.pmod(F.xxhash64("nid"), c)
    entries = entries.withColumn("block", F.when(F.col("rest") | (F.col("nm") == 0), hashed(F.col("nr"))).otherwise(F.col("nr") + hashed(F.greatest("nm", F.lit(1)))))
    partners = F.sequence(F.lit(0).cast("long"), F.when(F.col("block") < F.col("nr"), F.col("nr") + F.col("nm") - 1).otherwise(F.col("nr") - 1))
    entries = entries.withColumn("other", F.explode(partners))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    entries = entries.select(
        F.xxhash64("list", low, high).alias("group"), "nid", "n", "prev", "at", "comp", "rest", "sketch",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"),
    )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = block_pairs(table)
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs = staged(entries.groupBy("group").applyInArrow(compare, "a long, b long"), "residual")
    release(main)
    return pairs.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_copies, text_key, first_key.

    A document's set are its distinct shingles of five words, lower-cased (A-Z); of fewer words, the whole sequence as one.
    Documents are linked when 100 * intersection >= 80 * union; component_id is the smallest doc_id that links reach, and
    n_copies the rows with the very same set.  Without words or text the set is empty and linked with nothing.  Repeated
    rows are equal sets; a null doc_id takes part but names a component only if all its doc_ids are null.
    text_key is a hash of the row's text and first_key that of the row that names its component (null: it has only this row),
    for drop_near_duplicates.  Other columns are ignored; an empty table gives no rows.
    """
    frequent, hot = _frequent(docs)
    sig = _signatures(docs, frequent)
    full = sig.where("n > 0")
    groups = full.groupBy("group_key", "n").agg(F.first("prefix").alias("prefix"))
    groups = staged(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = full.groupBy("set_key", "group_key").agg(least, F.first("n").alias("n"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = classes.join(groups.select("group_key", "gid"), "group_key").drop("group_key")
    classes = staged(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    names = staged(sig.select("doc_id", "text_key", "n", "set_key"), "set_names")
    members = staged(classes.groupBy("gid").agg(F.min("nid").alias("rep"), F.count("*").alias("size")), "members")
    many = members.where("size > 1")

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = groups.agg(F.sum(F.length("prefix")) / 8).first()[0] or 0
    met = _meetings(groups, max(4 * partitions, int(postings) // BUCKET_POSTINGS + 1), hot)
    release(groups, sig)
    met_pairs = met.where("kind = 0").select("a", "b")
    if len(hot[0]):  # the parts of a list meet by their pivots: the earliest one with all others
        parts = met.where("kind = 2").select("list", F.col("a").alias("gid"), "at")
        top = parts.groupBy("list").agg(F.min(F.struct("at", "gid"))["gid"].alias("top"))
        stars = parts.join(top, "list").where("gid <> top").select(F.least("gid", "top").alias("a"), F.greatest("gid", "top").alias("b"))
        met_pairs = met_pairs.unionByName(stars)
    met_pairs = staged(met_pairs.distinct(), "met_pairs")

    # first: representatives of the groups that met, and each group's members with its representative
    rep = lambda c: members.select(F.col("gid").alias(c), F.col("rep").alias(f"rep_{c}"))
    of_groups = met_pairs.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    in_groups = classes.join(many, "gid").where("nid <> rep").select(F.col("rep").alias("a"), F.col("nid").alias("b"))
    first = staged(of_groups.unionByName(in_groups).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    possible = _possible(classes, first)
    links = _verified(docs, classes, possible)
    roots = components(links)
    release(possible, links)

    # then: whatever could still be linked across components
    labelled = classes.join(roots.select(F.col("u").alias("nid"), F.col("v").alias("root")), "nid", "left")
    labelled = staged(labelled.select("nid", "gid", "n", F.coalesce("root", "nid").alias("comp"), "sketch"), "labelled")
    zero, none = F.lit(0).cast("long").alias("prev"), F.lit(0).alias("at")
    long_lists = met.where("kind = 1").select("list", F.col("a").alias("gid"), "prev", "at")
    group_lists = many.select(F.xxhash64(F.lit("g"), "gid").alias("list"), "gid", zero, none)
    wide = met_pairs.join(many.select(F.col("gid").alias("a"), F.lit(1).alias("wide_a")), "a", "left")
    wide = wide.join(many.select(F.col("gid").alias("b"), F.lit(1).alias("wide_b")), "b", "left").where("wide_a = 1 or wide_b = 1")
    pair_lists = wide.select(F.xxhash64(F.lit("p"), "a", "b").alias("list"), F.explode(F.array("a", "b")).alias("gid"), zero, none)
    lists = long_lists.unionByName(group_lists).unionByName(pair_lists).join(labelled, "gid").select(*_LISTED)
    lists = staged(lists, "lists")
    second = staged(_residual(lists).join(first, ["a", "b"], "left_anti"), "pairs")
    release(lists, labelled, met)
    if not second.isEmpty():
        more = _verified(docs, classes, second)
        if not more.isEmpty():
            roots = components(roots.unionByName(more))

    joined = classes.join(roots.select(F.col("u").alias("nid"), F.col("v").alias("root")), "nid", "left")
    joined = joined.select("set_key", "first", "copies", F.coalesce("root", "nid").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("first").alias("least"), F.count("*").alias("parts"))
    named = joined.join(least, "comp").where("copies > 1 or parts > 1")
    named = staged(named.select("set_key", F.col("least").alias("first"), "copies"), "named")
    release(classes, members, met_pairs, first, second)
    return names.join(named, "set_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        "text_key",
        F.col("first.text_key").alias("first_key"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which near_duplicates leaves one a component.

    It is the row with the component's smallest doc_id (null: last); of rows that share it, the one whose text comes first by
    its hash, and of repeated rows one.  Rows are judged one by one: another text under a dropped row's doc_id stays, and rows
    without words all stay.  An empty table gives no rows.
    """
    near = near_duplicates(docs)
    copies = F.col("first_key").isNotNull()
    leads = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    marks = near.select("doc_id", "text_key", (~copies | leads).alias("kept"), copies.alias("once"))
    return keep_marked(docs, marks, F.xxhash64(whole_text(docs)))
