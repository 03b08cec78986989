"""Lexicons, error statistics, splits and synthetic errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.functions.alphabet import TAGS, TONE_TAGS
from vispark.functions.syllable import apply_tag, candidate_rows, candidates, tone
from vispark.functions.text import apart, first_byte, gaps, hash_below, running_sums, tokens, unit_hash
from vispark.operators.draws import broken_batches
from vispark.sources.staging import staged

_HOI_NGA = [k for k, t in enumerate(TONE_TAGS) if t in ("TONE_HOI", "TONE_NGA")]


def lexicon(tokens: DataFrame, min_count: int = 20) -> DataFrame:
    """word, cnt, docs of the words with min_count occurrences at least."""
    out = tokens.groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("docs"))
    return out.where(F.col("cnt") >= min_count)


def mine_split(text):
    """mine or eval, by the first byte of the text's hash."""
    return F.when(first_byte(text) < 128, "mine").otherwise("eval")


def train_split(text):
    """train, dev or test, 90 to 5 to 5, by a hash: the order of files plays no part."""
    u = unit_hash(7, text)
    return F.when(u < 0.90, "train").when(u < 0.95, "dev").otherwise("test")


#: Bits of the bitmap by which rows are sifted before a join (4 MB).
SIFT_BITS = 1 << 25


def sifted(rows: DataFrame, value: Column, members: DataFrame, member: str) -> DataFrame:
    """Rows whose value may be among the members: all that are, and a few that share a hash with one.

    Before a join on that value this keeps most of what finds no partner out of the exchange.  The bitmap over the members' hashes goes to
    all tasks and has a fixed size, in words of 64 bits.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIFT_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 as int))")
    words = members.select(place(F.col(member)).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    met = rows.withColumn("_at", place(value)).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"))
    return met.where(F.col("_bits").bitwiseAND(bit("_at")) != 0).select(*rows.columns)


def tag_candidates(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """word -> word, idx, tag, result for each distinct word: KEEP, and the tags whose result is a known word.

    Words and known ones are staged, as long as a vocabulary each: several steps read them.
    """
    once = words.select("word").distinct()
    if known is None:
        return candidate_rows(once)
    once, named = staged(once, "words"), known is words
    rows, names = candidate_rows(once), (once if named else staged(known.select("word"), "known")).withColumnRenamed("word", "_known")
    changed = sifted(rows.where("tag <> 'KEEP'"), F.lower("result"), names, "_known")
    kept = changed.join(names, F.lower("result") == F.col("_known"), "left_semi")
    return once.select("word", F.lit(0).alias("idx"), F.lit("KEEP").alias("tag"), F.col("word").alias("result")).unionByName(kept)


def tag_table(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """word -> src, dst, _tag: the first tag that leads from a word to another, a row for each two."""
    table = tag_candidates(words, known).where("tag <> 'KEEP'").groupBy(F.col("word").alias("src"), F.col("result").alias("dst")).agg(F.min("idx").alias("_idx"))
    return table.select("src", "dst", F.get(F.array(*[F.lit(t) for t in TAGS]), F.col("_idx")).alias("_tag"))  # a number needs no sort to be aggregated


def tags_between(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """pairs (src, dst) with tag: KEEP if equal, else the first tag that leads from one to the other, else null."""
    out = pairs.join(tag_table(pairs.select(F.col("src").alias("word")), known), ["src", "dst"], "left")
    return out.withColumn("tag", F.when(F.col("src") == F.col("dst"), "KEEP").otherwise(F.col("_tag"))).drop("_tag")


def corruptions(words: DataFrame, known: DataFrame) -> DataFrame:
    """word -> word, tag (that breaks it), broken, fix: changes of a word that a tag can undo into a known word.

    What is undone is the word itself, so words that are not known are left out first, and the first tag that leads back is found in the row.
    """
    names = known.select(F.col("word").alias("_known"))
    good = words.select("word").distinct().join(names, F.lower("word") == F.col("_known"), "left_semi")
    breaks = candidate_rows(good).where("tag <> 'KEEP'").select(F.col("word").alias("_from"), F.col("tag").alias("_tag"), F.col("result").alias("word"))
    breaks = breaks.repartition(int(breaks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")  # few bytes, but much work
    back = F.get(F.filter("_candidates", lambda c: (c["idx"] > 0) & (c["result"] == F.col("_from")) & (F.col("_from") != F.col("word"))), F.lit(0))
    rows = apart(candidates(breaks, "_from", "_tag"), _fix=back["tag"]).where(F.col("_fix").isNotNull())
    return rows.select(F.col("word").alias("broken"), F.col("_from").alias("word"), F.col("_tag").alias("tag"), F.col("_fix").alias("fix"))


# How likely a token that can be broken is, how many errors a sentence has at most, and the shares of the classes of
# errors: of tones by the pair of tones, of the others by the tag that repairs them.
ERROR_RATE, MAX_ERRORS = 0.04, 4
CLASS_WEIGHTS = {
    "hoi_nga": 0.34, "missing": 0.24, "other_tone": 0.10, "CH_TR": 0.05, "TR_CH": 0.05, "S_X": 0.05, "X_S": 0.05, "D_GI": 0.03, "GI_D": 0.03,
    "D_R": 0.01, "R_D": 0.01, "GI_R": 0.01, "R_GI": 0.01, "L_N": 0.03, "N_L": 0.03, "N_NG": 0.02, "NG_N": 0.01, "C_T": 0.005, "T_C": 0.005,
}


def error_class(word, broken, fix):
    """Class of an error: the tag that repairs it; for tones hoi_nga, missing (the mark is gone) or other_tone."""
    was, now = tone(word), tone(broken)
    both = was.isin(*_HOI_NGA) & now.isin(*_HOI_NGA)
    return F.when(~F.startswith(fix, F.lit("TONE_")), fix).when(both, "hoi_nga").when((now == 0) & ~was.eqNullSafe(F.lit(0)), "missing").otherwise("other_tone")


def draw(seed: int, *keys):
    """A number in (0, 1) from a hash of the keys that is cheap enough for each option of each token."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(float(2**53))


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, sent, pos, tok: the tokens of documents, pos within the document, with the number of their sentence; made within the row."""
    rows = running_sums(_cuts(docs.select("doc_id", "text")).where(F.size("_toks") > 0), "_cuts", "_before")
    zipped = F.arrays_zip(F.col("_toks").alias("tok"), F.col("_cuts").alias("cut"), F.col("_before").alias("before"))
    rows = rows.select("doc_id", F.posexplode(zipped).alias("pos", "t"))
    return rows.select("doc_id", (F.col("t.before") + F.col("t.cut")).cast("long").alias("sent"), "pos", F.col("t.tok").alias("tok"))


def _cuts(rows: DataFrame) -> DataFrame:
    """rows (text) with _toks and, instead of the text, _cuts: 1 for the tokens that begin a sentence, 0 for others."""
    rows = apart(rows, _toks=tokens(F.col("text")), _gaps=gaps(F.col("text"))).drop("text")
    met = lambda t, i: F.concat(F.get("_gaps", i), F.substring(t, 1, 1)).rlike(r"[.!?]\s+[A-ZÀ-Ỹ]").cast("int")
    cut = lambda t, i: F.when(F.length(F.get("_gaps", i)) < 2, 0).otherwise(met(t, i))  # noqa: E731  # most gaps are one blank
    return apart(rows, _cuts=F.transform("_toks", cut)).drop("_gaps")


def corrupt(tokens: DataFrame, options: DataFrame, rate: float = ERROR_RATE, most: int = MAX_ERRORS, seed: int = 11, weights: dict[str, float] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """doc_id, sent, pos, tok -> doc_id, pos, tok with broken ones put in, tag; tag is what repairs a token.

    options: word (as written), broken, fix.  factors: propensity's word (in lower case) and factor; others have 1.
    A sentence gets as many errors as its tokens with options whose hash is under the rate, at most `most`.  For each, first a
    class is drawn by weight among those with tokens left, then an option of the class by factor; a token breaks once.
    The draws are smallest exponential keys from hashes, -ln(u) / weight.  Documents come as wholes: corrupt_texts takes them as they are.
    """
    rows = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent", "pos", "tok"))).alias("t"))
    field = lambda f: F.transform("t", lambda x: x[f])
    rows = rows.select("doc_id", field("tok").alias("_toks"), field("sent").alias("_sents"), field("pos").alias("_pos"))
    out = _broken(rows, lambda r: r, F.col("_toks"), F.size("_toks") * 6, options, rate, most, seed, weights, factors)
    return out.select("doc_id", F.inline(F.arrays_zip(F.col("pos"), F.col("toks").alias("tok"), F.col("tags").alias("tag"))))


def corrupt_texts(docs: DataFrame, options: DataFrame, rate: float = ERROR_RATE, most: int = MAX_ERRORS, seed: int = 11, weights: dict[str, float] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """doc_id, text -> doc_id, toks, tags: as corrupt, a row for each text with tokens, whose places count from 0; each row by itself."""
    made = lambda r: _cuts(r).withColumnRenamed("_cuts", "_sents").withColumn("_pos", F.lit(None).cast("array<int>"))
    rows = docs.select("doc_id", "text")
    return _broken(rows, made, tokens(F.col("text")), F.length("text"), options, rate, most, seed, weights, factors, True).select("doc_id", "toks", "tags")


#: Characters of a chunk, the texts that share a table of their words' options, on the mean.
CHUNK_CHARS = 32_000_000


def _broken(rows: DataFrame, made, words: Column, chars: Column, options: DataFrame, rate: float, most: int, seed: int, weights: dict[str, float] | None, factors: DataFrame | None, cumulative: bool = False) -> DataFrame:
    """rows (doc_id and more) -> doc_id, pos, toks, tags; made: rows with _toks, _sents and _pos, words: their distinct words at least.

    Rows are dealt to chunks by doc_id.  A chunk gets the options of its distinct words, so a row travels once and its tokens not at all; a chunk's
    table is as long as its own vocabulary, and there are more chunks the longer the texts.
    """
    spark, table = rows.sparkSession, dict(CLASS_WEIGHTS if weights is None else weights)
    opts = options.withColumn("class", error_class(F.col("word"), F.col("broken"), F.col("fix")))
    opts = opts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("broken", "fix", "class"))).alias("opts"))
    if factors is not None:
        opts = opts.join(factors.select(F.col("word").alias("_word"), "factor"), F.lower("word") == F.col("_word"), "left")
        opts = opts.select("word", "opts", F.coalesce("factor", F.lit(1.0)).alias("factor"))
    else:
        opts = opts.withColumn("factor", F.lit(1.0))
    opts = staged(opts, "options")  # for the sieve and for the chunks
    total = rows.agg(F.sum(chars.cast("long"))).first()[0] or 0  # one number
    chunks = max(-(-total // CHUNK_CHARS), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    each = rows.select("chunk", F.explode(words).alias("word")).distinct()
    each = sifted(each, F.col("word"), opts.select(F.col("word").alias("_member")), "_member").join(opts, "word")
    both = rows.withColumn("word", F.lit(None).cast("string")).unionByName(each, allowMissingColumns=True)
    both = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", F.col("word").isNull())
    rest = [c for c in both.columns if c not in ("doc_id", *(c for c in rows.columns if c != "chunk"))]
    hit = (lambda p: hash_below(rate, seed, F.col("doc_id"), p)) if rate < 1 else lambda p: F.lit(True)
    shown = made(both)
    places = F.transform("_toks", lambda t, i: hit(i)) if cumulative else F.transform("_pos", hit)
    shown = shown.select(
        *rest, "doc_id", F.col("_toks").alias("toks"), F.col("_sents").cast("array<long>").alias("sents"), F.col("_pos").cast("array<int>").alias("pos"), places.alias("hits"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("state"), F.xxhash64(F.lit(seed + 2), F.col("doc_id")).alias("by_class"),
    ).where(F.col("word").isNotNull() | (F.size("toks") > 0))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return shown.mapInArrow(lambda batches: broken_batches(batches, table, most, cumulative), f"doc_id {kind}, pos array<int>, toks array<string>, tags array<string>")


def class_weights(pairs: DataFrame) -> DataFrame:
    """pairs (class) -> class, n, weight: shares of the classes, to four places."""
    counts = pairs.groupBy("class").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def propensity(pairs: DataFrame) -> DataFrame:
    """pairs (want, wrong) -> word, n, errors, factor: a word's smoothed error rate over the common one, from 0.2 to 20."""
    error = F.col("want") != F.col("wrong")
    per = staged(pairs.groupBy(F.col("want").alias("word")).agg(F.count("*").alias("n"), F.count_if(error).alias("errors")), "errors")  # for the sums, too
    base = per.agg((F.sum("errors") / F.sum("n")).alias("base"))
    rate = (F.col("errors") + 3 * F.col("base")) / (F.col("n") + 3) / F.col("base")
    return per.crossJoin(F.broadcast(base)).where("base > 0").select("word", "n", "errors", F.bround(F.least(F.greatest(rate, F.lit(0.2)), F.lit(20.0)), 6).alias("factor"))


def balanced(cases: DataFrame, per_word: int = 3, per_tag: int = 120, seed: int = 5) -> DataFrame:
    """cases (tag, word, ...): per_word of each tag and word at most, then per_tag of each tag, in the order of a hash."""
    rows = cases.withColumn("_u", unit_hash(seed, F.col("tag"), F.col("word"), F.col("doc_id"), F.col("pos")))
    by = lambda *c: Window.partitionBy(*c).orderBy("_u", "doc_id", "pos")
    rows = rows.withColumn("_n", F.row_number().over(by("tag", F.lower("word")))).where(F.col("_n") <= per_word)
    return rows.withColumn("_n", F.row_number().over(by("tag"))).where(F.col("_n") <= per_tag).drop("_u", "_n")


def unbroken(tokens_: Column, tags: Column) -> Column:
    """The correct tokens of a sample: each tag applied to its token, in parallel."""
    def one(t: Column, tag: Column) -> Column:
        out = t
        for name in TAGS[1:]:
            out = F.when(tag == name, apply_tag(name, t)).otherwise(out)
        return F.when(tag == "KEEP", t).otherwise(out)

    return F.zip_with(tokens_, tags, one)


def fits_training(sentence: Column) -> Column:
    """Whether a sentence has 5 to 64 tokens."""
    return F.size(tokens(sentence)).between(5, 64)


def out_of_lexicon(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens that the lexicon lacks."""
    return rows.join(known.select(F.col("word").alias("_known")), F.col("lower") == F.col("_known"), "left_anti")
