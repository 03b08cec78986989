"""Window plans of sentences that are too long for a model, in time linear in the words, within the sentence's row.

A plan is an array of (from, to) over the words of a sentence, made from counts, the pieces of each word (at least one).  Its
fold goes from window to window and finds each end by binary search in the running sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vispark.functions.text import apart, running_sums

# Pieces of a window at most, and by how many it moves on (None: to its end), by name of the plan; and the pieces of a
# model's input without its first and last one.
PLANS = {"F1": (40, None), "F2": (64, 32), "F2s": (48, 24), "none": None}
BUDGET = 94

_WINDOWS = "array<struct<from: int, to: int>>"
#: Each step of a fold copies what it has gathered: windows are gathered in blocks of so many.
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once, within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def how_many(ordered: Column, fits: Callable[[Column], Column]) -> Column:
    """How many elements of an ordered array fit, where those that fit come first; by binary search."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(fits(F.get(ordered, mid)), right).otherwise(left)

    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(ordered).cast("double"))).cast("int"))
    return F.aggregate(rounds, begin, halve, lambda s: s["lo"])


def chain(following: Callable[[Column], Column], n: Column) -> Column:
    """Array of 0, following(0), following(following(0)), ... below n; following must be larger than what it is given.

    A fold copies what it has gathered at each step, so places are gathered in blocks, and blocks in blocks.
    """
    empty = F.array().cast("array<int>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one(s: Column, _: Column) -> Column:
        return F.when(s["at"] >= n, s).otherwise(state(following(s["at"]).cast("int"), F.array_append(s["out"], s["at"])))

    def several(inner: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def step(s: Column, _: Column) -> Column:
            some = F.aggregate(F.sequence(F.lit(1), F.lit(_BLOCK)), state(s["at"], empty), inner)
            return F.when(s["at"] >= n, s).otherwise(let(some, lambda b: state(b["at"], F.concat(s["out"], b["out"]))))

        return step

    rounds = F.sequence(F.lit(1), F.floor(n / (_BLOCK * _BLOCK)).cast("int") + 1)
    return F.aggregate(rounds, state(F.lit(0), empty), several(several(one)), lambda s: s["out"])


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows (counts) with _offs, the pieces before each word and, last, of all; rows that have them stay, and the steps below keep them."""
    if "_offs" in rows.columns:
        return rows
    rows = running_sums(apart(rows, _counts=F.transform("counts", lambda x: x.cast("int"))), "_counts", "_before")
    last = F.when(F.size("_counts") > 0, F.element_at("_before", -1) + F.element_at("_counts", -1)).otherwise(0)
    return apart(rows, _offs=F.array_append("_before", last)).drop("_counts", "_before")


def run_plan(rows: DataFrame, fallback: str = "F2", budget: int = BUDGET) -> DataFrame:
    """rows (counts) with plan: one window if all pieces fit into the budget, else windows by the named plan; none for no words.

    A window always moves on, and a word that is longer than a window gets one of its own.  `none` leaves it one window, which
    the encoding then cuts off.  counts must not be null.
    """
    if fallback not in PLANS:
        raise ValueError(f"no such plan: {fallback}")
    n = F.size("counts")
    whole = F.array(F.struct(F.lit(0).alias("from"), n.alias("to")))
    if PLANS[fallback] is None:
        return rows.withColumn("plan", F.when(n == 0, F.array().cast(_WINDOWS)).otherwise(whole))
    size, stride = PLANS[fallback]
    none = F.array().cast(_WINDOWS)
    win, offs = min(size, budget), F.col("_offs")

    def window(at: Column) -> Column:
        """The window that begins at a word, and where the next one begins; no arrays, as what a lambda gives is copied."""

        def moved(begin: Column, to: Column) -> Column:
            after = to if stride is None else F.least(to, F.greatest(at + 1, how_many(offs, lambda o: o < begin + stride)))
            return F.struct(at.alias("from"), to.alias("to"), after.alias("next"))

        end = lambda begin: F.greatest(at + 1, how_many(offs, lambda o: o <= begin + win) - 1)
        return let(F.get(offs, at), lambda begin: let(end(begin), lambda to: moved(begin, to)))

    def step(a: Column, _: Column) -> Column:
        it, done = a["it"], a["it"]["to"] >= n
        part = F.array_append(a["part"], F.struct(it["from"].alias("from"), it["to"].alias("to")))
        following = F.when(done, it).otherwise(window(it["next"]))
        return F.when(a["done"], a).otherwise(F.struct(following.alias("it"), done.alias("done"), part.alias("part")))

    def block(a: Column, _: Column) -> Column:
        begin = F.struct(a["it"].alias("it"), a["done"].alias("done"), none.alias("part"))
        some = F.aggregate(F.sequence(F.lit(1), F.lit(_BLOCK)), begin, step)
        grown = lambda b: F.struct(b["it"].alias("it"), b["done"].alias("done"), F.array_append(a["out"], b["part"]).alias("out"))
        return F.when(a["done"], a).otherwise(let(some, grown))

    # Two windows together have at least this many pieces more than the ones that begin two places before.
    gain = win if stride is None else min(stride, max(win - stride, 1))
    most = F.least(n, F.floor(2 * F.element_at(offs, -1) / gain).cast("int") + 2)
    start = F.struct(window(F.lit(0)).alias("it"), F.lit(False).alias("done"), F.array().cast(f"array<{_WINDOWS}>").alias("out"))
    blocks = F.sequence(F.lit(1), F.floor(most / _BLOCK).cast("int") + 1)
    windows = F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"]))
    plan = F.when(n == 0, none).when(F.element_at(offs, -1) <= budget, whole).otherwise(windows)
    return apart(with_offsets(rows), plan=plan).select(*rows.columns, "plan")


def owned(rows: DataFrame, overlap: int = 2) -> DataFrame:
    """rows (counts, plan) with windows: from, to and own, the words that are farthest from an edge, in pieces, in this window.

    Of windows in which a word is equally deep, the first has it; each word is in one window's own.  overlap: how many windows before and
    behind one may share words with it; a window that moves by half its size shares none with the next but one.
    """
    offs, plan = F.col("_offs"), F.col("plan")

    def depth(w: Column, i: Column) -> Column:
        before = lambda k: F.get(offs, k)
        return F.least(before(i) - before(w["from"]), before(w["to"]) - before(i + 1))

    def beaten(i: Column, w: Column, r: Column) -> Column:
        others = F.sequence(F.greatest(r - overlap, F.lit(0)), F.least(r + overlap, F.size(plan) - 1))

        def better(j: Column) -> Column:
            return let(F.get(plan, j), lambda o: (o["from"] <= i) & (i < o["to"]) & ((depth(o, i) > depth(w, i)) | ((depth(o, i) == depth(w, i)) & (j < r))))

        return F.exists(others, better)

    def with_own(w: Column, r: Column) -> Column:
        words = F.sequence(w["from"], w["to"] - 1)
        own = F.when(F.size(plan) == 1, words).otherwise(F.filter(words, lambda i: ~beaten(i, w, r)))
        return F.struct(w["from"].alias("from"), w["to"].alias("to"), own.alias("own"))

    return apart(with_offsets(rows), windows=F.transform(plan, with_own)).select(*rows.columns, "windows")


def centred(plans: DataFrame, key: str = "key") -> DataFrame:
    """key, counts, plan -> key, word, run: for each word, the window in which it is farthest from an edge; of equals the first."""
    kept = [c for c in ("_offs",) if c in plans.columns]
    each = owned(plans.select(key, "counts", "plan", *kept)).select(key, F.posexplode("windows").alias("run", "w"))
    return each.select(key, F.explode("w.own").alias("word"), "run")
