"""Phrase collocations by Suffix-sigma: one shuffle of truncated suffixes counts all phrases up to max_words words.

Each place of a text gives its suffix, cut at max_words words, at the end of its piece, and at the first word that is too rare to
be in any candidate.  Equal suffixes are added up in the task, and those with one first word travel as one row.  They are shuffled by
language and first word.  As one first word may begin a third of all suffixes, those of a frequent word are dealt to several parts, by a hash of
the words that follow up to the first that is not frequent: so no word and no pair of words is bound to one task.  The suffixes of a first word
are sorted in reverse order, and one stack counts all prefixes: a phrase is done when the suffix on hand no longer begins with it.  Phrases of
frequent words alone are counted by several tasks, and those counts are added up.

Rare words are known by a bitmap of fixed size over the hashes of the others: a hash that two words share keeps a rare word in,
which costs time and changes no count.  In suffixes, the commonest words, a table of fixed length, are written as single characters and all
others as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.llm.common import maybe_broadcast, release, staged, whole_text

MAX_WORDS, MIN_COUNT, BEST = 5, 100, 2000
#: Pieces end at these; words within a piece are separated by blanks and tabs.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Language of texts without one.
NO_LANGUAGE = "und"
#: Bits of the bitmap of words that are not rare (16 MB).
BITMAP_BITS = 1 << 27
#: Suffixes, or different words, that a task holds before it hands them on.
HELD = 250_000
#: Words that a worker remembers how to write.
REMEMBERED = 500_000
#: Words that are written as single characters.
CODED = 150_000
#: A word is frequent that begins more suffixes than this many mean partitions, and is dealt to parts of that size; there are as many at
#: most as partitions, over it.
HOT_SHARE = 1.0
#: Buckets that a partition of the shuffle has on average: first words travel by bucket, and a task holds one bucket at a time.
BUCKETS = 8
#: Different prefixes by which the best phrases of a language are sought at first.
RANK_PARTS = 64

#: Ranges of characters that stand for words, the shortest in UTF-8 first; a word that is written out has a tab before and a blank behind it.
_CODES = ((0x21, 0x7F), (0xA1, 0x800), (0x800, 0xD800))
_TOKEN = re.compile("\t[^ ]* |.", re.DOTALL)
_BITS = 32_768  # of a bucket of Spark's bitmap functions
_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_COUNT_SQL = "lang string, phrase string, n long"
#: Suffixes of a bucket of first words (and parts of them): by first word and part, what follows it, sorted and joined by line ends, and how often
#: each is found, the numbers of all first words in a row.
_HEAD = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("heads", pa.list_(pa.string())), ("parts", pa.list_(pa.int32())), ("rests", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])
_HEAD_SQL = "bucket int, lang string, heads array<string>, parts array<int>, rests array<string>, n array<int>"
#: By language, the frequent words, as they are written, and the number of their parts.
Hot = dict[str, dict[str, int]]


def pieces(text: str) -> Iterator[list[str]]:
    """The words of each piece, A-Z lower-cased."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").replace("\t", " ")  # of bytes, lower() changes A-Z only
    for end in ENDS[1:]:
        text = text.replace(end, ENDS[0])
    for piece in text.split(ENDS[0]):
        if words := [w for w in piece.split(" ") if w]:
            yield words


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    return zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang, text in _rows(batch):
            counts = held.setdefault(lang, {})
            for words in pieces(text):
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            if sum(map(len, held.values())) >= HELD:
                yield from _given_out(held)
                held = {}
    yield from _given_out(held)


def _given_out(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNT)


def code(rank: int) -> str | None:
    """The character of a language's word of this rank, null beyond the last."""
    for begin, end in _CODES:
        if rank < end - begin:
            return chr(begin + rank)
        rank -= end - begin
    return None


def tokens(suffix: str) -> list[str]:
    return _TOKEN.findall(suffix) if "\t" in suffix else list(suffix)


class Writing:
    """How words are written in suffixes: by their language's codes, else in full, and rare ones not at all."""

    def __init__(self, codes: dict[str, dict[str, str]], buckets: dict[int, bytes]):
        self.codes, self.buckets, self.known = codes, buckets, {}

    def of(self, lang: str) -> dict[str, str]:
        """What is known by now; a caller adds what `token` gives."""
        if sum(map(len, self.known.values())) > REMEMBERED:
            self.known = {}
        return self.known.setdefault(lang, {})

    def token(self, lang: str, word: str) -> str:
        """Empty for a rare word."""
        import xxhash

        short = self.codes.get(lang, {}).get(word)
        if short is not None:
            return short
        bit = xxhash.xxh64_intdigest(f"{lang}\0{word}".encode("utf-8", "surrogatepass"), 42) % BITMAP_BITS
        bucket = self.buckets.get(bit // _BITS)
        return f"\t{word} " if bucket is not None and bucket[bit % _BITS // 8] >> bit % 8 & 1 else ""


def word_codes(words: DataFrame, coded: int = CODED) -> dict[str, dict[str, str]]:
    """words (lang, word, n) -> by language, the characters of the commonest words, `coded` at most over all languages."""
    out: dict[str, dict[str, str]] = {}
    for r in words.orderBy(F.desc("n"), "lang", "word").limit(coded).collect():  # a table of fixed length
        own = out.setdefault(r.lang, {})
        if (short := code(len(own))) is not None:
            own[r.word] = short
    return out


def _bitmap(words: DataFrame) -> dict[int, bytes]:
    """lang, word -> the set bits as bytes by bucket: BITMAP_BITS of them, however many words there are."""
    bit = F.pmod(F.xxhash64(F.concat("lang", F.lit("\0"), "word")), F.lit(BITMAP_BITS))
    # Spark's positions begin with bucket 1 at value 1.
    rows = words.select(F.bitmap_bucket_number(bit + 1).alias("bucket"), F.bitmap_bit_position(bit + 1).alias("at"))
    rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    return {r.bucket - 1: bytes(r.bits) for r in rows.collect()}  # 16 MB at most


class Suffixes:
    """Truncated suffixes by their first word and its part."""

    def __init__(self, hot: Hot, max_words: int, buckets: int = 1):
        self.hot, self.max_words, self.buckets, self.size = hot, max_words, buckets, 0
        self.counts: dict[str, dict[str | tuple[str, int], dict[str, int]]] = {}

    def add(self, lang: str, words: list[str]) -> None:
        """The suffixes, of two words at least, of written words that stand together."""
        hot, counts, n, most = self.hot.get(lang, {}), self.counts.setdefault(lang, {}), len(words), self.max_words
        self.size += n - 1
        for i in range(n - 1):
            head = words[i]
            if head in hot:
                j, end = i + 2, min(i + most, n)
                while j < end and words[j - 1] in hot:
                    j += 1
                head = head, zlib.crc32("".join(words[i + 1 : j]).encode("utf-8", "surrogatepass")) % hot[head]
            rest = "".join(words[i + 1 : i + most])
            rests = counts.get(head)
            if rests is None:
                counts[head] = {rest: 1}
            else:
                rests[rest] = rests.get(rest, 0) + 1

    def given_out(self) -> pa.RecordBatch:
        """A row for each bucket and language, whatever the number of first words."""
        rows: dict[tuple[int, str], tuple[list, list, list, list]] = {}
        for lang, all_heads in self.counts.items():
            for head, found in all_heads.items():
                order = sorted(found)
                word, part = (head, 0) if isinstance(head, str) else head
                bucket = zlib.crc32(f"{lang}\0{word}\0{part}".encode("utf-8", "surrogatepass")) % self.buckets
                heads, parts, rests, n = rows.setdefault((bucket, lang), ([], [], [], []))
                heads.append(word), parts.append(part), rests.append("\n".join(order)), n.extend([found[r] for r in order])
        self.counts, self.size = {}, 0
        return _batch(_HEAD, [(*key, *row) for key, row in rows.items()])


def truncated_suffixes(docs: DataFrame, writing: Broadcast, hot: Hot, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, text; codes and bitmap -> bucket, lang, heads, parts, rests, n."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, write = Suffixes(hot, max_words, buckets), Writing(*writing.value)
        for batch in batches:
            for lang, text in _rows(batch):
                known = write.of(lang)
                for words in pieces(text):
                    run: list[str] = []
                    for w in words:
                        written = known.get(w)
                        if written is None:
                            written = known[w] = write.token(lang, w)
                        if written:
                            run.append(written)
                        elif run:
                            if len(run) > 1:
                                held.add(lang, run)
                            run = []
                    if len(run) > 1:
                        held.add(lang, run)
                    if held.size >= HELD:
                        yield held.given_out()
        yield held.given_out()

    return docs.mapInArrow(cut, _HEAD_SQL)


def prefix_counts(suffixes: list[tuple[str, int]], min_count: int, hot: dict[str, int]) -> Iterator[tuple[bool, list[str], int]]:
    """(suffix, n) in reverse order -> partial, written words, n of all prefixes of two words at least that are found min_count times.

    Those of frequent words alone (partial) are given out whatever their count, as other parts may add to it.  The stack holds the words of the suffix on
    hand, for each of its prefixes the count of what has gone from above it, and whether it is partial.
    """
    stack: list[str] = []
    counts: list[int] = []
    partial: list[bool] = []

    def popped(keep: int) -> Iterator[tuple[bool, list[str], int]]:
        while len(stack) > keep:
            n, some = counts.pop(), partial.pop()
            if len(stack) > 1 and (n >= min_count or some):
                yield some, stack[:], n
            stack.pop()
            if counts:
                counts[-1] += n

    for suffix, n in suffixes:
        words, same = tokens(suffix), 0
        for a, b in zip(stack, words):
            if a != b:
                break
            same += 1
        if same < len(stack):
            yield from popped(same)
        for w in words[same:]:
            partial.append((not partial or partial[-1]) and w in hot)
            counts.append(0)
            stack.append(w)
        counts[-1] += n
    yield from popped(0)


def head_counts(head: str, rests: list[str], n: list[int], min_count: int, hot: dict[str, int]) -> Iterator[tuple[bool, list[str], int]]:
    """All suffixes with one first word, in one part of it -> partial, written words, n.  Pairs that are too rare need no sorting."""
    seconds = [r[0] if r[0] != "\t" else r[: r.index(" ") + 1] for r in rests]
    pairs: dict[str, int] = {}
    for w, k in zip(seconds, n):
        pairs[w] = pairs.get(w, 0) + k
    often = {w for w, k in pairs.items() if k >= min_count or head in hot and w in hot}
    suffixes = [(head + r, k) for r, w, k in zip(rests, seconds, n) if w in often]
    suffixes.sort(reverse=True)
    return prefix_counts(suffixes, min_count, hot)


def phrase_counts(suffixes: DataFrame, writing: Broadcast, hot: Hot, min_count: int = MIN_COUNT) -> DataFrame:
    """bucket, lang, heads, parts, rests, n -> lang, phrase (of two words at least), n, of those found min_count times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        out: list[tuple[str, str, int]] = []
        partial: dict[tuple[str, str], int] = {}
        words_of: dict[str, dict[str, str]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            lang = key[1]
            if lang not in words_of:
                words_of[lang] = {c: w for w, c in writing.value[0].get(lang, {}).items()}
            plain = words_of[lang]
            while held:
                (head, _), (rests, n) = held.popitem()
                for some, words, k in head_counts(head, [r for more in rests for r in more.split("\n")], [k for ns in n for k in ns], min_count, hot.get(lang, {})):
                    phrase = " ".join(plain[w] if len(w) == 1 else w[1:-1] for w in words)
                    if some:
                        partial[lang, phrase] = partial.get((lang, phrase), 0) + k
                    else:
                        out.append((lang, phrase, k))
                if len(out) + len(partial) >= 50_000:
                    yield given_out()

        def given_out() -> pa.RecordBatch:
            rows = out + [(*k, v) for k, v in partial.items()]
            out.clear(), partial.clear()
            return _batch(_COUNT, rows)

        for batch in batches:
            bucket, lang, heads, parts, rests, n = (batch.column(c) for c in range(6))
            for i, place in enumerate(zip(bucket.to_pylist(), lang.to_pylist())):
                if place != key:
                    yield from done()
                    key = place
                numbers, at = n[i].values.to_numpy(), 0
                for head, part, more in zip(heads[i].as_py(), parts[i].as_py(), rests[i].as_py()):
                    some, end = held.setdefault((head, part), ([], [])), at + more.count("\n") + 1
                    some[0].append(more), some[1].append(numbers[at:end].tolist())
                    at = end
        yield from done()
        yield given_out()

    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang")
    counts = dealt.mapInArrow(count, _COUNT_SQL)
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def with_scores(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a), words (lang, word, n), totals (lang, n) -> lang, phrase, a, l, r, n, score.

    A phrase is cut after its first k words; the cut with the lowest score counts, of equals the smallest k.  Products have up to
    38 digits, as decimals, and are divided as whole numbers.
    """
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    parts = parts.unionByName(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    k = F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1))
    cuts = phrases.select("lang", "phrase", "a", k.alias("k")).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substr(phrase, length(head) + 2)"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(parts.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000BD * {whole('a')} * {whole('n')}) DIV ({whole('l')} * {whole('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    out = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("low"))
    return out.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def contained(phrases: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) -> lang, phrase, longest_a: the largest count of the phrases that are one word longer.

    Counts fall as phrases grow, so if any longer phrase is found as often, one that is a single word longer is.
    """
    ends = F.array(F.expr("substr(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"))
    shorter = phrases.select("lang", F.explode(ends).alias("phrase"), "a").where(F.instr("phrase", " ") > 0)
    return shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))


def best_in_language(scored: DataFrame, best: int) -> DataFrame:
    """scored with rank: the first `best` of each language.  Sought by part of a language first, so no task has all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= best)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best).drop("_part")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, best: int = BEST, cover: int = 100, coded: int = CODED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `best` phrases of each language by score, a and phrase.

    A phrase has 2 to max_words words that stand together in a piece at least min_count times (a; overlaps count).
    n counts all words of the language, l and r are the counts of the two parts that it falls into at the cut with the lowest
    score, floor(1000 * a * n / (l * r)).  A phrase goes if it is part of a longer one of these that is found cover percent as often.
    A null text counts as empty, a null lang as und; repeated rows count as often as they stand there; other columns are
    ignored, and an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), whole_text(docs).alias("text"))
    counts = texts.mapInArrow(_count_words, _COUNT_SQL).groupBy("lang", F.col("phrase").alias("word")).agg(F.sum("n").alias("n"))
    counts = staged(counts, "word_counts")
    totals = staged(counts.groupBy("lang").agg(F.sum("n").alias("n")), "language_totals")
    words = staged(counts.where(F.col("n") >= min_count), "frequent_words")
    release(counts)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(int((totals.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE / parts), min_count)
    writing = docs.sparkSession.sparkContext.broadcast((word_codes(words, coded), _bitmap(words)))  # CODED words and 16 MB
    hot: Hot = {}
    for r in words.where(F.col("n") > most).collect():  # parts / HOT_SHARE at most
        hot.setdefault(r.lang, {})[writing.value[0].get(r.lang, {}).get(r.word) or f"\t{r.word} "] = -(-r.n // most)
    suffixes = truncated_suffixes(texts, writing, hot, max_words)
    phrases = staged(phrase_counts(suffixes, writing, hot, min_count).withColumnRenamed("n", "a"), "phrases")
    scored = with_scores(phrases, words, maybe_broadcast(totals)).join(contained(phrases), ["lang", "phrase"], "left")
    scored = scored.where(F.coalesce(F.col("longest_a"), F.lit(0)) * 100 < F.col("a") * cover).drop("longest_a")
    return best_in_language(scored, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
