"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text come from vectorised passes over its bytes and word hashes. Training bins them by
quantiles and grows depth-limited trees level by level on gradient histograms. The finished trees are
flattened into arrays; scoring walks all rows of a batch through all trees with numpy, one level at a time.

The model is fitted on at most ``fit_rows`` labelled rows, the ones with the smallest hash of their
doc_id; everything else covers all rows. Rows whose crc32(doc_id as text) mod 5 is 0 never enter the fit.

Defined cases: null or empty texts have all statistics 0 and are scored like others; labels that are null
are not used; labels of both values for one document both count; without any usable label every score is
0.5; repeated rows are scored each; further columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import slices
from .words import SPACE, mix, spans, text_bytes, window_hashes, word_hashes

FIT_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "letters", "upper", "digits", "marks", "non_ascii", "spaces", "lines_per_word",
    "distinct_words", "distinct_pairs", "top_word", "marked_words", "short_words", "sentence_ends", "commas", "odd_marks", "line_words", "line_ends_in_stop", "lower_starts",
)

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_HIGH = np.arange(256) >= 128
_MARK = ~(_LETTER | _DIGIT | _HIGH | SPACE)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".?!"])
_COMMA = np.isin(np.arange(256), [ord(c) for c in ",;:"])
_ODD = _MARK & ~_STOP & ~_COMMA & ~np.isin(np.arange(256), [ord(c) for c in "\"'()-"])


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end, doc = spans(data, offsets)
    words = np.bincount(doc, minlength=n).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    length = (end - start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    hashes = word_hashes(data, start, end)

    def runs(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each text, and how often its most frequent key occurs."""
        if not len(key):
            return np.zeros(n), np.zeros(n)
        order = np.argsort(mix(key + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        k, o = key[order], own[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        top = np.zeros(n)
        np.maximum.at(top, o[first], np.diff(np.r_[first, len(k)]))
        return np.bincount(o[first], minlength=n).astype(float), top

    distinct, top = runs(hashes, doc)
    pair = window_hashes(hashes, 2)
    inside = doc[1:] == doc[:-1]
    pairs, _ = runs(pair[inside], doc[1:][inside])
    lines = total(data == 10)
    word_marks = np.bincount(doc, weights=_MARK[data[end - 1]], minlength=n) if len(end) else np.zeros(n)
    short = np.bincount(doc, weights=length <= 3, minlength=n)
    lower = np.bincount(doc, weights=(data[start] >= 97) & (data[start] <= 122), minlength=n) if len(start) else np.zeros(n)
    breaks = np.flatnonzero(data[1:] == 10) if len(data) > 1 else np.zeros(0, np.int64)
    stops = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, weights=_STOP[data[breaks]], minlength=n) if len(breaks) else np.zeros(n)
    byte = data
    return np.column_stack([
        np.log1p(size), np.log1p(words), total(~SPACE[byte]) / per_word, longest, total(_LETTER[byte]) / per_byte, total(_UPPER[byte]) / per_byte,
        total(_DIGIT[byte]) / per_byte, total(_MARK[byte]) / per_byte, total(_HIGH[byte]) / per_byte, total(SPACE[byte]) / per_byte, lines / per_word,
        distinct / per_word, pairs / np.maximum(words - 1, 1), top / per_word, word_marks / per_word, short / per_word, total(_STOP[byte]) / per_word,
        total(_COMMA[byte]) / per_word, total(_ODD[byte]) / per_word, words / (lines + 1), stops / np.maximum(lines, 1), lower / per_word,
    ])


class Trees:
    """Boosted trees as arrays: node i of tree t has a statistic, a bound, and children 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, bound: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.bound, self.value, self.base = feature, bound, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.feature.shape[1] + 1)) if len(self.feature) else 0
        rows = np.arange(len(x))
        for feature, bound, value in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of binned statistics."""
    if not len(y):
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    inner = 2**depth - 1
    chance = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(chance / (1 - chance)))
    now = np.full(len(y), base)
    features, bounds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-now))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, bound = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            best = np.full(many, 1e-6)
            where, split = np.zeros(many, int), np.full(many, BINS)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = at * BINS + binned[:, f]
                g = np.bincount(cell, weights=grad, minlength=many * BINS).reshape(many, BINS).cumsum(1)
                h = np.bincount(cell, weights=hess, minlength=many * BINS).reshape(many, BINS).cumsum(1)
                gl, hl, ga, ha = g[:, : len(c)], h[:, : len(c)], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best[better], where[better], split[better] = gain[np.arange(many), top][better], f, top[better]
            for k in range(many):
                feature[first + k] = where[k]
                if split[k] < BINS:
                    bound[first + k] = cuts[where[k]][split[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), where[at]] > split[at])
        leaf = node - inner
        g, h = np.bincount(leaf, weights=grad, minlength=inner + 1), np.bincount(leaf, weights=hess, minlength=inner + 1)
        value = -rate * g / (h + ridge)
        now += value[leaf]
        features.append(feature), bounds.append(bound), values.append(value)
    return Trees(np.array(features), np.array(bounds), np.array(values), base)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Fit on the ``fit_rows`` labelled rows of smallest hash; that many ids are broadcast, their statistics collected."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = statistics(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("quality")), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    # of rows that share a doc_id, the one of smallest text, so there are at most as many rows as labels
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = chosen.select("text", "quality").mapInArrow(numbers, "quality double, x array<double>").toArrow()
    y = rows.column("quality").to_numpy()
    x = np.array(rows.column("x").to_pylist()).reshape(len(y), len(STATISTICS))
    order = np.lexsort([*x.T, y])  # the order of arrival doesn't matter
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = model.score(statistics(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, scored where they lie: no shuffle."""
    model, width = train(docs, labels), len(docs.columns)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"c{i}" for i in range(width)]
        for b in slices(batches, f"c{at}"):
            yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(model.score(statistics(b.column(at))) >= threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


@llm_query("op5_quality_scores")
def op5_quality_scores(spark, sf_dir: str) -> DataFrame:
    """Score of every document by trees that learnt from labels.quality."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
