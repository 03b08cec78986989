"""From text to issues by a model: sentences, pieces, windows, scores, decisions and spans.

Each distinct sentence is scored once, and what it gives is joined back to all places where it stands.  A model is a file that
is shipped to the executors and loaded once a worker.  Windows go to it in batches of a fixed number, in the order of their lengths.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.functions.alphabet import TAGS
from vispark.functions.groups import display_group
from vispark.functions.text import GAP_END, apart, gaps, tokens, with_starts
from vispark.operators import corpus, decisions
from vispark.operators.encoding import MAX_PIECES, merge_word
from vispark.sources.staging import staged
from vispark.operators.windows import how_many, let, owned, run_plan, with_offsets

#: Piece ids (windows, pieces) and their mask (1: a piece, 0: filled up) -> logits (windows, pieces, tags).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Windows that a model gets at a time.
BATCH = 32

_LOADED: dict[tuple, Model] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary (piece, id) and merges in their order, as read_tokenizer gives them, with the ids of special pieces."""

    vocabulary: dict[str, int]
    merges: list[tuple[str, str]]
    bos: int = 0
    pad: int = 1
    eos: int = 2
    unknown: int = 3


@dataclass(frozen=True)
class ModelFile:
    """A model that load makes from the file at path, on the executors; path may be null if load needs none."""

    load: Callable[[str | None], Model]
    path: str | None = None


def onnx_model(path: str | None) -> Model:
    """Inputs input_ids and attention_mask, output logits or else the first, on one thread."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    names = [o.name for o in session.get_outputs()]
    wanted = "logits" if "logits" in names else names[0]
    return lambda ids, mask: session.run([wanted], {"input_ids": ids.astype(np.int64), "attention_mask": mask.astype(np.int64)})[0]


def hash_model(path: str | None) -> Model:
    """A stand-in: logits from 0 to 8 by a hash of a piece, its neighbours and its place; the file, if any, holds a number to begin with."""
    seed = int(open(path).read()) if path else 0  # noqa: SIM115

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = np.pad(ids.astype(np.uint64) * mask.astype(np.uint64), ((0, 0), (1, 1)))
        mixed = x[:, 1:-1] * np.uint64(0x9E3779B97F4A7C15) + x[:, :-2] * np.uint64(0xC2B2AE3D27D4EB4F) + x[:, 2:] * np.uint64(0x165667B19E3779F9)
        mixed = mixed[:, :, None] + (np.arange(ids.shape[1], dtype=np.uint64) + np.uint64(seed))[None, :, None] * np.uint64(0x27D4EB2F165667C5)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * (np.arange(len(TAGS), dtype=np.uint64) * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9))
        return (mixed >> np.uint64(56)).astype(np.float64) / 32.0

    return run


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent, words, starts (of the words, in code points): a row a sentence, made within the document's row.

    A sentence ends where the gap between two words has one of . ! ? … or a line end; texts without words give no rows.
    """
    rows = apart(docs.select(F.col(key), F.col(text)), _toks=tokens(F.col(text)), _gaps=gaps(F.col(text))).drop(text).where(F.size("_toks") > 0)
    rows = apart(with_starts(rows), _begins=F.filter(F.sequence(F.lit(0), F.size("_toks") - 1), lambda i: (i == 0) | F.get("_gaps", i).rlike(GAP_END)))
    start = lambda i: F.get("_before", i) + F.length(F.get("_gaps", i))

    def sentence(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_begins", k + 1), F.size("_toks"))
        words = F.slice("_toks", begin + 1, end - begin)
        return F.struct(k.alias("sent"), words.alias("words"), F.transform(F.sequence(begin, end - 1), start).alias("starts"))

    return rows.select(key, F.inline(F.transform("_begins", sentence)))


def marked(options: DataFrame, word: str) -> np.ndarray:
    """A bitmap of a fixed size, by checksums of words: a word without its bit is none of these."""
    at = F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(corpus.SIFT_BITS))
    parts = options.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    table, bits = parts.toArrow(), np.zeros(corpus.SIFT_BITS // 64, np.int64)  # the bitmap's size at most
    bits[table.column("part").to_numpy()] = table.column("bits").to_numpy()
    return bits


def piece_rows(sentences: DataFrame, tokenizer: Tokenizer, budget: int, short: bool, bits: np.ndarray | None = None) -> DataFrame:
    """key, words -> key, words, _ids (of the pieces of each word), may (whether a word is looked for), short: ids, own; of the short ones or of the others.

    A sentence whose pieces fit into the budget is short, a window of its own, and needs no plan; its words and _ids are left out.  A word is taken
    apart once a worker; as long as a vocabulary, the tokenizer goes along.  Sentences without a word that is looked for (by bits) are left out.
    """
    ranks = {pair: i for i, pair in enumerate(tokenizer.merges)}
    known: dict[str, tuple[list[int], bool]] = {}

    def looked_up(word: str) -> tuple[list[int], bool]:
        out = known.get(word)
        if out is None:
            if len(known) > 500_000:
                known.clear()
            ids = [tokenizer.vocabulary.get(p, tokenizer.unknown) for p in merge_word(word, ranks)] or [tokenizer.unknown]
            at = zlib.crc32(word.encode()) % corpus.SIFT_BITS
            out = known[word] = ids, bits is None or bool(int(bits[at // 64]) >> at % 64 & 1)
        return out

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists = batch.column("key"), batch.column("words")
            coded = lists.flatten().dictionary_encode()
            found = [looked_up(w) for w in coded.dictionary.to_pylist()]
            codes = coded.indices.to_numpy()
            may = np.array([m for _, m in found], bool)[codes]
            counts = np.array([len(i) for i, _ in found], np.int64)[codes]
            ids = pa.array([i for i, _ in found], pa.list_(pa.int32()))
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(lengths))
            pieces, asked = (np.append(0, np.cumsum(x)) for x in (counts, may))
            row_pieces = pieces[ends[1:]] - pieces[ends[:-1]]
            wanted = asked[ends[1:]] > asked[ends[:-1]]
            row = np.repeat(np.arange(len(lengths)), lengths)
            if len(lengths):
                rows = np.flatnonzero(wanted & ((row_pieces <= budget) == short))
                at = np.flatnonzero(np.isin(row, rows, kind="table")) if len(rows) else np.empty(0, np.int64)
                words, each = coded.dictionary.take(pa.array(codes[at])), ids.take(pa.array(codes[at]))
                bounds = np.append(0, np.cumsum(lengths[rows]))
                none = pa.array(np.zeros(len(rows) + 1, np.int32))
                if short:
                    sizes = row_pieces[rows] + 2
                    stops = np.append(0, np.cumsum(sizes))
                    flat = np.full(stops[-1], -1, np.int32)
                    flat[stops[:-1]], flat[stops[1:] - 1] = tokenizer.bos, tokenizer.eos
                    inner = np.ones(len(flat), bool)
                    inner[stops[:-1]] = inner[stops[1:] - 1] = False
                    flat[inner] = each.flatten().to_numpy()
                    own = may[at]
                    pos = at - ends[row[at]]
                    first = pieces[at] - pieces[ends[row[at]]] + 1
                    owned_by = np.append(0, np.cumsum(own))[bounds]
                    struct = pa.StructArray.from_arrays([words.filter(pa.array(own)), pa.array(pos[own], pa.int32()), pa.array(first[own], pa.int32())], ["word", "pos", "first"])
                    windows = pa.StructArray.from_arrays(
                        [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(owned_by, pa.int32()), struct)], ["ids", "own"]
                    )
                    columns = [pa.ListArray.from_arrays(none, words.slice(0, 0)), pa.ListArray.from_arrays(none, ids.slice(0, 0)), pa.ListArray.from_arrays(none, pa.array([], pa.bool_()))]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), windows))
                else:
                    bounds = pa.array(bounds, pa.int32())
                    columns = [pa.ListArray.from_arrays(bounds, words), pa.ListArray.from_arrays(bounds, each), pa.ListArray.from_arrays(bounds, pa.array(may[at]))]
                    columns.append(pa.ListArray.from_arrays(none, pa.array([], _WINDOW)))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(rows)), *columns], names=["key", "words", "_ids", "may", "short"])

    return sentences.select("key", "words").mapInArrow(split, f"key string, words array<string>, _ids array<array<int>>, may array<boolean>, short array<{_OWN}>")


_OWN = "struct<ids: array<int>, own: array<struct<word: string, pos: int, first: int>>>"
_WINDOW = pa.struct({"ids": pa.list_(pa.int32()), "own": pa.list_(pa.struct({"word": pa.string(), "pos": pa.int32(), "first": pa.int32()}))})


def encoded_windows(sentences: DataFrame, tokenizer: Tokenizer, fallback: str = "F2", max_pieces: int = MAX_PIECES, bits: np.ndarray | None = None) -> DataFrame:
    """key, words -> key, ids (a model's input), own: word, pos, first (its first piece in ids) of the words that this window decides.

    A word that does not fit whole between the first and the last piece, and those behind it, are cut off and in no row's own.  bits: as
    `marked` gives them; words without a bit are in no row's own, either.
    """
    budget = max_pieces - 2
    short = piece_rows(sentences, tokenizer, budget, True, bits).select("key", F.inline("short"))
    # A piece has a letter at least, so only sentences of more letters than that can be long; they alone go through the steps of a plan.
    rows = piece_rows(sentences.where(F.length(F.array_join("words", " ")) >= budget), tokenizer, budget, False, bits)
    rows = with_offsets(apart(rows, counts=F.transform("_ids", lambda x: F.size(x))))
    rows = owned(run_plan(rows, fallback, budget))
    offs = F.col("_offs")

    def encoded(w: Column) -> Column:
        begin = F.get(offs, w["from"])
        fitting = F.least(w["to"], how_many(offs, lambda o: o <= begin + budget) - 1)

        def cut(to: Column) -> Column:
            pieces = F.flatten(F.slice("_ids", w["from"] + 1, F.greatest(to - w["from"], F.lit(0))))
            own = F.transform(
                F.filter(w["own"], lambda i: (i < to) & F.get("may", i)), lambda i: F.struct(F.get("words", i).alias("word"), i.alias("pos"), (F.get(offs, i) - begin + 1).alias("first"))
            )
            return F.struct(F.concat(F.array(F.lit(tokenizer.bos)), pieces, F.array(F.lit(tokenizer.eos))).alias("ids"), own.alias("own"))

        return let(fitting, cut)

    return rows.select("key", F.inline(F.transform("windows", encoded))).unionByName(short).where(F.size("own") > 0)


def score_windows(windows: DataFrame, model: ModelFile, pad: int = 1, batch: int = BATCH) -> DataFrame:
    """encoded_windows -> key, pos, word, logits.  Within a task windows are sorted by length, so little is filled up."""
    name = None
    if model.path is not None:
        windows.sparkSession.sparkContext.addFile(model.path)
        name = os.path.basename(model.path)
    load = model.load

    def loaded() -> Model:
        from pyspark import SparkFiles

        key = (load.__module__, load.__qualname__, model.path)
        if key not in _LOADED:
            _LOADED[key] = load(SparkFiles.get(name) if name else None)
        return _LOADED[key]

    def scored(some: pa.Table) -> pa.RecordBatch:
        key, each, own = (some.column(c).combine_chunks() for c in ("key", "ids", "own"))
        lengths = pc.list_value_length(each).to_numpy()
        mask = np.arange(lengths.max()) < lengths[:, None]
        ids = np.full(mask.shape, pad, np.int64)
        ids[mask] = each.flatten().to_numpy()
        logits = loaded()(ids, mask.astype(np.int64))
        word, pos, first = own.flatten().flatten()
        window = np.repeat(np.arange(len(lengths)), pc.list_value_length(own).to_numpy())
        picked = np.asarray(logits[window, first.to_numpy()], np.float64)
        ends = np.arange(len(picked) + 1, dtype=np.int32) * picked.shape[1]
        columns = [key.take(pa.array(window)), pos, word, pa.ListArray.from_arrays(pa.array(ends), pa.array(picked.ravel()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "pos", "word", "logits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for more in batches:
            table = pa.Table.from_batches([*held, more])
            full = table.num_rows - table.num_rows % batch
            for at in range(0, full, batch):
                yield scored(table.slice(at, batch))
            held = table.slice(full).to_batches()
        if held:
            yield scored(pa.Table.from_batches(held))

    return windows.sortWithinPartitions(F.size("ids")).mapInArrow(run, "key string, pos int, word string, logits array<double>")


def word_options(words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """word -> word, tags, results and idx (of the tags), in tag order, of the words that have any beside KEEP."""
    rows = corpus.tag_candidates(words, lexicon)
    per = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("idx", "tag", "result"))).alias("o")).where(F.size("o") > 1)
    field = lambda f: F.transform("o", lambda x: x[f]).alias(f)
    return per.select("word", field("idx"), field("tag").alias("tags"), field("result").alias("results"))


def scored_words(
    sentences: DataFrame, model: ModelFile, tokenizer: Tokenizer, lexicon: DataFrame | None = None, fallback: str = "F2", max_pieces: int = MAX_PIECES, batch: int = BATCH
) -> DataFrame:
    """Distinct sentences (key, words) -> key, pos, word, tags, results and logits (parallel) of the words that a window reaches and that have a choice."""
    sentences = staged(sentences.select("key", "words"), "sentences")  # for the windows and for the words
    options = staged(word_options(sentences.select(F.explode("words").alias("word")).distinct(), lexicon), "word_options")
    # A sentence without a word that has a choice is not scored: what the model says of it is not asked for.
    scores = score_windows(encoded_windows(sentences, tokenizer, fallback, max_pieces, marked(options, "word")), model, tokenizer.pad, batch)
    return scores.join(options, "word").select("key", "pos", "word", "tags", "results", F.transform("idx", lambda i: F.get("logits", i)).alias("logits"))


def distinct_sentences(sentences: DataFrame) -> DataFrame:
    """words -> key, words: each sentence once."""
    return sentences.groupBy(sentence_key(F.col("words")).alias("key")).agg(F.first("words").alias("words"))


def sentence_key(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def score_text(
    docs: DataFrame, model: ModelFile, tokenizer: Tokenizer, lexicon: DataFrame | None = None, fallback: str = "F2", max_pieces: int = MAX_PIECES, batch: int = BATCH, **gate
) -> DataFrame:
    """doc_id, start, end, original, suggestion, why, tag (its group), confidence, source of what the model would change.

    docs: doc_id, text; a null text has no issues, and rows that share an id are judged one by one.  lexicon: word; changes that lead to no word of it
    are not considered.  gate: thresholds, as decisions.gate takes them.  Words with nothing to choose from are not decided.
    """
    sentences = sentence_rows(docs).withColumn("key", sentence_key(F.col("words")))
    rows = scored_words(distinct_sentences(sentences), model, tokenizer, lexicon, fallback, max_pieces, batch)
    found = decisions.gate(rows, **gate).where("decision <> 'KEEP'")
    new = F.get("results", F.array_position("tags", F.col("best")).cast("int") - 1)
    found = found.select("key", "pos", new.alias("suggestion"), F.col("best").alias("tag"), F.col("best_p").alias("confidence"))
    found = staged(found, "found")  # for the sieve and for the rows
    sentences = corpus.sifted(sentences, F.col("key"), found.select(F.col("key").alias("_member")), "_member")
    # One row for each distinct sentence with issues, so that a sentence that stands everywhere can be split by the join.
    hits = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "suggestion", "tag", "confidence"))).alias("hits"))
    placed = sentences.join(hits, "key").select("doc_id", "words", "starts", F.inline("hits"))
    original, start = F.get("words", "pos"), F.get("starts", "pos")
    percent = F.floor(F.col("confidence") * 100 + 0.5).cast("string")
    why = F.concat(F.lit('Model đề xuất "'), "suggestion", F.lit('" ('), percent, F.lit("%)."))
    return placed.select(
        "doc_id",
        start.alias("start"),
        (start + F.length(original)).alias("end"),
        original.alias("original"),
        "suggestion",
        why.alias("why"),
        display_group(F.col("tag"), original, F.col("suggestion")).alias("tag"),
        "confidence",
        F.lit("model").alias("source"),
    )
