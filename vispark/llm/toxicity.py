"""Toxicity as severity grades, by cumulative-link ordinal regression over sparse text features.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight for each feature, shared by all ordered thresholds.
Features are words and their first letters (a family of made-up words shares its stem), as the logarithm of one plus their
count, and that of the text's length, so that a rate can count as well as a number.  Grade 0 are the rows labelled clean; the
rows labelled toxic are split into three grades by how many words they have that hardly occur in clean rows.

The model is fitted on a bounded sample of labelled rows.  Their features are counted on the executors; the driver gets
the counts of the features that tell the classes apart, never a text.  Each row is rated once by a model that
has not seen it, and the severity from which a document counts as toxic is chosen on those ratings.  Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from vispark.llm.common import release, returning, staged, whole_row, whole_text

#: Labelled rows of each class that the fit reads at most.
MAX_ROWS_PER_CLASS = 1500
#: Features of a model, the strongest; they are in so many toxic rows of the sample at least.
MAX_FEATURES = 600
MIN_DOCS = 2
#: Log odds from which a feature speaks for toxicity, and from which it grades it.
MIN_ODDS, STRONG_ODDS = 1.5, 2.5
GRADES = 4
PREFIXES = (4, 5, 6)
#: Parts of the sample that are rated by a model of the other parts.
FOLDS = 4
#: A clean document costs so many times a missed toxic one where the threshold is chosen.
CLEAN_COST = 10.0
CACHE_WORDS = 100_000
#: The feature of the text's length, in words.
LENGTH = "#"

_WORD = re.compile(r"[^\W\d_]+")
_SCORE = StructType(
    [StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType()), StructField("hits", LongType())]
)


def features(piece: str) -> list[str]:
    """Features of a stretch of text without spaces: its words, and their first letters."""
    out = []
    for w in _WORD.findall(piece.lower()):
        out.append(w)
        out += [w[:n] + "-" for n in PREFIXES if len(w) > n]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class SeverityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = math.inf
    #: Words that grade a toxic row, and the numbers of them above which it is of the second and the third grade.
    strong: frozenset[str] = frozenset()
    levels: tuple[float, ...] = ()
    #: Of the sample, each row rated by a model that has not seen it: severity, whether it is toxic, and its grade by that model's rule.
    unseen: tuple[tuple[float, int, int], ...] = ()

    def severity(self, counts: dict[str, int]) -> tuple[float, int]:
        """Expected grade, and the likeliest one; counts may have LENGTH."""
        if not self.thresholds:
            return 0.0, 0
        score = sum(self.weights.get(f, 0.0) * math.log1p(n) for f, n in sorted(counts.items()))
        above = 1 - _sigmoid(np.array(self.thresholds) - score)
        each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), int(each.argmax())


    def grade(self, counts: dict[str, int]) -> int:
        """The grade of a row that is labelled toxic, by its strong words."""
        amount = sum(c for f, c in counts.items() if f in self.strong)
        return 1 + sum(amount > level for level in self.levels)


class Counts:
    """Counts the features of a text that are in known; known: None for all."""

    def __init__(self, known: set[str] | None = None):
        self.known, self.cache = known, {}

    def of(self, text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        words = 0
        for piece, n in Counter(text.split()).items():
            found = self.cache.get(piece)
            if found is None:
                if len(self.cache) > CACHE_WORDS:
                    self.cache.clear()
                every = features(piece)
                found = tuple(f for f in every if self.known is None or f in self.known), sum(not f.endswith("-") for f in every)
                self.cache[piece] = found
            for f in found[0]:
                out[f] += n
            words += n * found[1]
        out[LENGTH] = words
        return out


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the penalised mean likelihood."""
    k = grades - 1
    p = np.concatenate([np.zeros(x.shape[1]), [0.5], np.zeros(k - 1)])  # weights, first threshold, logs of the steps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, jumps = p[:-k], np.exp(p[len(p) - k + 1 :])
        th = np.concatenate([[-np.inf], p[-k] + np.concatenate([[0], np.cumsum(jumps)]), [np.inf]])
        s = x @ w
        hi, lo = _sigmoid(th[y + 1] - s), _sigmoid(th[y] - s)
        chance = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        g_th = np.array([-(d_hi[y == j].sum() - d_lo[y == j + 1].sum()) for j in range(k)]) / len(y)
        tails = np.cumsum(g_th[::-1])[::-1]
        g = np.concatenate([x.T @ (d_hi - d_lo) / len(y) + l2 * w, [tails[0]], tails[1:] * jumps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:-k], p[-k] + np.concatenate([[0], np.cumsum(np.exp(p[len(p) - k + 1 :]))])


def choose_features(seen: dict[str, np.ndarray], sizes: np.ndarray, without: int | None = None) -> tuple[list[str], set[str]]:
    """The features that speak for toxicity, strongest first, and the words among them that grade it.

    seen: for each feature, in how many rows of each (class, fold) it is; sizes: how many rows these have.  without: a fold
    that does not count.
    """
    use = np.arange(sizes.shape[1]) != (-1 if without is None else without)
    n = np.maximum(1, sizes[:, use].sum(axis=1))
    rank, strong = {}, set()
    for f, counts in seen.items():
        clean, toxic = counts[:, use].sum(axis=1)
        odds = math.log((toxic + 0.5) / n[1]) - math.log((clean + 0.5) / n[0])
        if toxic >= MIN_DOCS and odds > MIN_ODDS:
            rank[f] = odds * math.sqrt(toxic)
            if odds > STRONG_ODDS and not f.endswith("-"):
                strong.add(f)
    return sorted(rank, key=lambda f: (-rank[f], f))[:MAX_FEATURES], strong


def fit_counts(rows: list[dict[str, int]], toxic: np.ndarray, chosen: list[str], strong: set[str]) -> SeverityModel:
    """The model of rows' counts of the chosen features; it finds nothing toxic if there are none, or only one class."""
    if not chosen or len(set(toxic.tolist())) < 2:
        return SeverityModel()
    place = {f: i for i, f in enumerate([LENGTH, *chosen])}
    x, amount = np.zeros((len(rows), len(place))), np.zeros(len(rows))
    for i, counts in enumerate(rows):
        for f, c in counts.items():
            if f in place:
                x[i, place[f]] = math.log1p(c)
        amount[i] = sum(c for f, c in counts.items() if f in strong and f in place)
    graded = (toxic == 1) & (amount > 0)
    levels = np.quantile(amount[graded], [1 / 3, 2 / 3]) if graded.any() else [0, 0]
    y = np.where(toxic == 1, 1 + (amount > levels[0]) + (amount > levels[1]), 0)
    w, th = fit_ordinal(x, y, GRADES)
    return SeverityModel({f: float(w[i]) for f, i in place.items()}, tuple(th.tolist()), 0.5, frozenset(strong & place.keys()), tuple(map(float, levels)))


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that catches the most toxic rows, each clean row caught costing CLEAN_COST of them by share."""
    best = (-math.inf, 0.0)
    for cut in [*np.unique(severity), 0.5]:
        flagged = severity >= cut
        best = max(best, (flagged[toxic == 1].mean() - CLEAN_COST * flagged[toxic == 0].mean(), cut))
    below = severity[severity < best[1]]
    return float((best[1] + below.max()) / 2 if len(below) else best[1])


def fit_severity(docs: DataFrame, labels: DataFrame, max_rows_per_class: int = MAX_ROWS_PER_CLASS) -> SeverityModel:
    """Fits on at most max_rows_per_class labelled rows of each class, taken by the hash of doc_id.

    Rows with a null label or doc_id are left out; of repeated labels the highest counts.  Without both classes the model
    finds nothing toxic.
    """
    known = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull())
    known = known.groupBy(known["doc_id"].cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("is_toxic"))
    some = None
    for t in (0, 1):
        part = known.where(F.col("is_toxic") == t).orderBy(F.xxhash64("id"), "id").limit(max_rows_per_class)
        some = part if some is None else some.unionByName(part)
    fold = (F.row_number().over(Window.partitionBy("is_toxic").orderBy(F.xxhash64("id"), "id")) % FOLDS).cast("int")
    some = some.withColumn("fold", fold)  # 2 * max_rows_per_class rows at most
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), whole_text(docs).alias("words"))
    sample = staged(texts.join(F.broadcast(some), "id").select("id", "words", "is_toxic", "fold"), "labelled")
    sizes = np.zeros((2, FOLDS), int)
    for r in sample.groupBy("is_toxic", "fold").count().collect():
        sizes[r.is_toxic, r.fold] = r["count"]
    if not sizes.sum(axis=1).all():
        return SeverityModel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for text, t, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen.update((f, t * FOLDS + k) for f in counts.of(text.as_py()) if f != LENGTH)
            names, cells, n = [f for f, _ in seen], [c for _, c in seen], list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cells, pa.int32()), pa.array(n, pa.int64())], ["f", "cell", "n"])

    cells = sample.select("words", "is_toxic", "fold").mapInArrow(returning(count), "f string, cell int, n long")
    per = cells.groupBy("f").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)])
    per = staged(per.where(_could_be_chosen(sizes)), "features")
    seen: dict[str, np.ndarray] = {}
    for without in (None, *range(FOLDS)):  # the strongest of each model: so many times MAX_FEATURES at most
        rows = per.orderBy(F.desc(_rank(sizes, without)), "f").limit(MAX_FEATURES).collect()
        seen |= {r.f: np.array([r[f"c{c}"] for c in range(2 * FOLDS)]).reshape(2, FOLDS) for r in rows}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(set(seen))
        kind = pa.map_(pa.string(), pa.int64())
        for batch in batches:
            found = [list(counts.of(text.as_py()).items()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), *batch.columns[1:]], ["found", "is_toxic", "fold", "id"])

    counted = sample.select("words", "is_toxic", "fold", "id").mapInArrow(returning(look_up), "found map<string, long>, is_toxic int, fold int, id long")
    rows = sorted(counted.collect(), key=lambda r: (r.id, r.is_toxic, sorted(r.found.items())))
    release(sample, per)
    counts, toxic, folds = [r.found for r in rows], np.array([r.is_toxic for r in rows]), np.array([r.fold for r in rows])
    severity, grades = np.zeros(len(rows)), np.zeros(len(rows), int)
    for k in range(FOLDS):
        train, test = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
        model = fit_counts([counts[i] for i in train], toxic[train], *choose_features(seen, sizes, k))
        severity[test] = [model.severity(counts[i])[0] for i in test]
        grades[test] = [model.grade(counts[i]) if toxic[i] else 0 for i in test]
    model = fit_counts(counts, toxic, *choose_features(seen, sizes))
    if model.thresholds:
        model.cut = best_cut(severity, toxic)
        model.unseen = tuple(zip(severity.tolist(), toxic.tolist(), grades.tolist()))
    return model


def _parts(sizes: np.ndarray, without: int | None) -> tuple[Column, Column, int, int]:
    use = [k for k in range(FOLDS) if k != without]
    total = lambda t: sum((F.col(f"c{t * FOLDS + k}") for k in use), F.lit(0))
    return total(1), total(0), max(1, int(sizes[1, use].sum())), max(1, int(sizes[0, use].sum()))


def _rank(sizes: np.ndarray, without: int | None) -> Column:
    """choose_features' rank as a column."""
    toxic, clean, n_toxic, n_clean = _parts(sizes, without)
    return (F.log((toxic + 0.5) / n_toxic) - F.log((clean + 0.5) / n_clean)) * F.sqrt(toxic)


def _could_be_chosen(sizes: np.ndarray) -> Column:
    """Whether a feature is in enough toxic rows for any of the models."""
    toxic, *_ = _parts(sizes, None)
    return toxic >= MIN_DOCS


def severity_column(model: SeverityModel, text: Column) -> Column:
    """severity (expected grade), grade (likeliest), toxic and hits of a text, as a struct."""

    @F.arrow_udf(_SCORE)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(set(model.weights))
        kinds = [pa.float64(), pa.int32(), pa.bool_(), pa.int64()]
        for batch in texts:
            made = []
            for text in batch:
                found = counts.of(text.as_py())
                severity, grade = model.severity(found)
                made.append((severity, grade, severity >= model.cut, sum(n for f, n in found.items() if f != LENGTH)))
            columns = [pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 4, kinds)]
            yield pa.StructArray.from_arrays(columns, _SCORE.fieldNames())

    return score(text)


def score_severity(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """One row per row of docs: doc_id, severity (expected grade), grade (likeliest), toxic, hits.

    hits counts the known features in the whole text.  Null and empty texts have the severity of no features; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), severity_column(model, whole_text(docs)).alias("s"))
    return rows.select("doc_id", "s.*")


def drop_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The rows of docs that the model does not rate toxic, with all their columns; repeated rows are rated alike."""
    rows = docs.select(whole_row(docs).alias("row"), severity_column(model, whole_text(docs)).alias("s"))
    return rows.where(~F.col("s.toxic")).select("row.*")
