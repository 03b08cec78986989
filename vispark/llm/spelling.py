"""Spelling variants by Aho-Corasick halves: near words, and the common form that each rare word stands for.

Of two words that differ by one letter put in, taken out or changed, one half of the longer stands unchanged at the beginning or the end of the
other.  Each word's halves go into automata, which are sharded by word length, side and outer letters; each word is scanned
by the shards in which a half of it can be, those of its own length and of one more.  A half counts where it stands at its
end of the word and the lengths agree; then the rest is verified.  Where many words share a half, the rest is
halved again and again, so that what is compared stays near what is found.

Shards have a bounded number of words: those of frequent outer letters are dealt to several.  The words to scan are streamed.
No pair leaves a shard: each word gets the number of its near words there and the most frequent of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.llm.common import maybe_broadcast, release, staged, whole_text
from vispark.llm.line_dedup import lower_ascii

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letters of a run: A-Z, a-z and the block from À to ÿ.
RUN = r"[A-Za-zÀ-ÿ]"
#: Outer letters by which halves are sharded: no more than the shortest half has.
OUTER = 3
#: Halves that an automaton holds, about; those of the same length, side and outer letters beyond it go to further ones.
SHARD_HALVES = 100_000
#: Words with the same half up to which all are compared.
DIRECT = 6

_FOUND_SQL = "word string, n_near long, best string, best_n long"
_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def letter_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, run: maximal runs of at least min_length letters, A-Z lower-cased, one row for each place; null texts have none."""
    found = F.regexp_extract_all(whole_text(docs), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.explode(found).alias("run")).withColumn("run", lower_ascii(F.col("run")))


def with_slips(runs: DataFrame, every: int = 199) -> Column:
    """The runs, of which one in `every` by the checksum of `<doc_id>:<run>` has lost a letter; a null doc_id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(runs["doc_id"].cast("string"), F.lit("")), F.lit(":"), runs["run"]))
    at = (h % F.length(runs["run"])).cast("int")
    slipped = F.concat(F.substring(runs["run"], F.lit(1), at), F.substring(runs["run"], at + 2, F.length(runs["run"])))
    return F.when(h % every == 0, slipped).otherwise(runs["run"])


def word_counts(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word -> word, n: words of at least min_length code points with at least min_count rows."""
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def differs_once(u: str, v: str) -> bool:
    """Whether v is u with one letter changed, or with one letter taken out."""
    short, i = len(u) - len(v), 0
    while i < len(v) and u[i] == v[i]:
        i += 1
    return u[i + 1 :] == v[i:] if short else i < len(u) and u[i + 1 :] == v[i + 1 :]


class Group:
    """Words of one length that agree outside [lo, hi); found by the half of that stretch which an edit leaves as it is."""

    __slots__ = ("words", "lo", "hi", "left", "right")

    def __init__(self, lo: int, hi: int):
        self.words: list[str] = []
        self.lo, self.hi = lo, hi
        self.left: dict[str, Group] | None = None
        self.right: dict[str, Group] | None = None

    def near(self, v: str, short: int, found: set[str]) -> None:
        """Adds to found the words of which v is one edit away; v agrees with them outside the stretch; short: v has one letter less."""
        lo, hi = self.lo, self.hi
        if len(self.words) <= DIRECT or hi - lo < 2:
            x = v[lo : hi - short]
            found.update(u for u in self.words if differs_once(u[lo:hi], x))
            return
        mid = (lo + hi) // 2
        if self.left is None:
            self.left, self.right = {}, {}
            for u in self.words:
                self.left.setdefault(u[lo:mid], Group(mid, hi)).words.append(u)
                self.right.setdefault(u[mid:hi], Group(lo, mid)).words.append(u)
        for group in (self.left.get(v[lo:mid]), self.right.get(v[mid - short : hi - short])):
            if group:
                group.near(v, short, found)


class Shard:
    """An automaton over the halves of words; what stands under a half are its groups by side, length and part (of those dealt to several)."""

    def __init__(self):
        import ahocorasick

        self.automaton, self.n, self.closed = ahocorasick.Automaton(), {}, False
        self.halves: dict[str, dict[tuple[int, int, int], Group]] = {}
        self.longer: dict[str, list] = {}

    def add(self, word: str, n: int, side: int, length: int, part: int) -> None:
        mid = length // 2
        half, lo, hi = (word[mid:], 0, mid) if side else (word[:mid], mid, length)
        self.halves.setdefault(half, {}).setdefault((side, length, part), Group(lo, hi)).words.append(word)
        self.n[word] = n

    def scan(self, v: str, n: int, side: int, length: int, part: int) -> tuple[str, int, str, int] | None:
        """(v, number of near words of the length that are found by this side, the most frequent of them, its number)."""
        if not self.closed:
            for half, groups in self.halves.items():
                self.automaton.add_word(half, (len(half), groups))
            if self.halves:
                self.automaton.make_automaton()
            self.closed = True
        if not self.halves:
            return None
        found, short, mid = set(), length - len(v), length // 2
        for end, (size, groups) in self.automaton.iter(v):
            if (end + 1 == len(v) if side else end + 1 == size) and (side, length, part) in groups:
                groups[side, length, part].near(v, short, found)
        if side:  # those whose first half stands in v as well come by that
            found = {u for u in found if u[:mid] != v[:mid]}
        if not found:
            return None
        if short:  # words of equal length find each other
            for u in found:
                got = self.longer.setdefault(u, [0, 0, ""])
                got[0] += 1
                if (-n, v) < (-got[1], got[2]):
                    got[1:] = [n, v]
        best = min(found, key=lambda u: (-self.n[u], u))
        return v, len(found), best, self.n[best]

    def rest(self) -> list[tuple[str, int, str, int]]:
        """The same for the words that shorter ones were found for."""
        return [(u, k, v, n) for u, (k, n, v) in self.longer.items()]


def _sides(words: DataFrame, lengths: Column, scan: bool) -> DataFrame:
    """A row for each side of a word and each of the lengths."""
    outer = lambda side: F.right("word", F.lit(OUTER)) if side else F.left("word", F.lit(OUTER))
    each = F.array(*[F.struct(F.lit(side).alias("side"), outer(side).alias("outer")) for side in (0, 1)])
    rows = words.select("word", "n", F.lit(scan).alias("scan"), F.explode(lengths).alias("length"), each.alias("sides"))
    return rows.select("word", "n", "scan", "length", F.inline("sides"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (shard, scan): the halves of a shard, then the words to scan."""
    shard, name, out = Shard(), None, []

    def flushed() -> pa.RecordBatch:
        columns = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    for batch in batches:
        for key, scan, word, n, *place in zip(*(batch.column(c).to_pylist() for c in ("shard", "scan", "word", "n", "side", "length", "part"))):
            if key != name:
                out += shard.rest()
                shard, name = Shard(), key
            if not scan:
                shard.add(word, n, *place)
            elif (row := shard.scan(word, n, *place)) is not None:
                out.append(row)
        yield flushed()
        out.clear()
    out += shard.rest()
    yield flushed()


def near_words(words: DataFrame, shard_halves: int = SHARD_HALVES) -> DataFrame:
    """words (word, n; distinct, of 6 code points at least) -> word, n_near, best, best_n of the words that have near ones.

    best is the near word with the largest n, of equals the smallest in code-point order.
    """
    spark = words.sparkSession
    halves = _sides(words, F.array(F.length("word")), False)
    scans = _sides(words, F.array(F.length("word"), F.length("word") + 1), True)
    sized = staged(halves.groupBy("side", "length", "outer").agg(F.count("*").alias("halves")), "halves")
    total = sized.agg(F.sum("halves")).first()[0] or 0  # one number
    hot = sized.where(F.col("halves") > shard_halves).withColumn("parts", F.ceil(F.col("halves") / shard_halves).cast("int"))
    hot = maybe_broadcast(staged(hot.select("side", "length", "outer", "parts"), "hot_halves"))
    release(sized)
    shards = max(-(-total // shard_halves), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["side", "length", "outer"]
    dealt = lambda rows, part: rows.join(hot, keys, "left").withColumn("part", part)
    own = F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0))
    rows = dealt(halves, own).unionByName(dealt(scans, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*keys, "part"), F.lit(shards)).cast("long"))
    rows = rows.select("shard", "scan", "word", "n", "side", "length", "part").repartition(shards, "shard").sortWithinPartitions("shard", "scan")
    found = rows.mapInArrow(_search, _FOUND_SQL).groupBy("word")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return found.agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def followed(links: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last.  Each round doubles the steps; forms must not go in circles."""
    roots, changed = staged(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots"), True
    while changed:
        further = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        met = roots.join(further, F.col("root") == F.col("_word"), "left")
        after = staged(met.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("open")), "roots")
        release(roots)
        roots, changed = after, not after.where("open").isEmpty()
    return roots.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, shard_halves: int = SHARD_HALVES) -> DataFrame:
    """words (word, n) -> word, form, root, n, n_near, form_n, one row a word.

    n_near counts the words that are one edit away.  form is the most frequent of them (of equals the smallest in code-point
    order) if its n is at least ratio * n, else null; root follows forms to the last and is the word itself if it has none.
    words must be distinct, not null and of 6 code points at least, as word_counts makes them; none give no rows.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, shard_halves)
    fits = F.col("best_n") >= ratio * F.col("n")
    out = staged(
        words.join(near, "word", "left").select(
            "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    release(words)
    roots = followed(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
