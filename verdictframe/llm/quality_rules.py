"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints on chosen features.

The trees are fitted on the driver, by histograms over at most TRAIN_ROWS labelled rows (a documented bound: the rows
with the smallest xxhash64 of their id), and flattened into numpy node arrays: feature, threshold, left and right
child, value. Scoring walks all rows of a batch down all trees at once. Along a constrained feature the margin
never rises (-1) or never falls (+1): a split against it is refused, and children are held on their side of the
midpoint.

Defined results: a null text counts as an empty one (no words, so it fails the base rules); labels that are null are
ignored; without any label every text gets probability 1 and the base rules alone decide. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, fold, keep_rows, only
from verdictframe.llm.statistics import BASE, FEATURES, document_statistics, matrix, text_statistics

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, HISTOGRAM, LEAST = 40, 4, 0.2, 64, 10
ACCEPT = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: More of these never makes a text better.
CONSTRAINTS = {"symbol_share": -1, "upper_share": -1, "exclamations_a_word": -1, "repeat_word_share": -1, "stutter_share": -1, "dup_line_share": -1}


@dataclass
class Forest:
    """All trees one after another: leaves point to themselves; roots has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def grow(x: np.ndarray, y: np.ndarray, constraints: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees of the log-odds of y (0 or 1), by histograms of each feature's quantiles."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, HISTOGRAM + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * HISTOGRAM
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    columns: tuple[list, ...] = ([], [], [], [], [])
    roots = []

    def add(value: float) -> int:
        at = len(columns[0])
        for column, v in zip(columns, (0, 0.0, at, at, value), strict=True):
            column.append(v)
        return at

    def split(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        if level == depth or len(rows) < 2 * LEAST:
            margin[rows] += columns[4][at]
            return
        where = flat[rows].ravel()
        sums = [np.bincount(where, weights=np.repeat(w, d), minlength=d * HISTOGRAM).reshape(d, HISTOGRAM).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
        gl, hl, nl = (s[:, :-1] for s in sums)
        gr, hr, nr = (s[:, -1:] - s[:, :-1] for s in sums)
        vl, vr = np.clip(-gl / (hl + 1), low, high), np.clip(-gr / (hr + 1), low, high)
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
        sign = constraints[:, None]
        gain[(nl < LEAST) | (nr < LEAST) | (sign * (vr - vl) < 0)] = 0
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] <= 1e-6 or b >= len(edges[j]):
            margin[rows] += columns[4][at]
            return
        goes_left = binned[rows, j] <= b
        values, middle = (float(vl[j, b]), float(vr[j, b])), float(vl[j, b] + vr[j, b]) / 2
        limits = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(constraints[j])]
        children = [add(rate * v) for v in values]
        for column, v in zip(columns, (int(j), float(edges[j][b]), children[0], children[1], 0.0), strict=True):
            column[at] = v
        for child, part, (lo, hi) in zip(children, (rows[goes_left], rows[~goes_left]), limits, strict=True):
            split(child, part, g, h, level + 1, lo, hi)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(add(0.0))
        split(roots[-1], np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf)
    feature, threshold, left, right, value = (np.array(c) for c in columns)
    return Forest(feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), np.array(roots), start, depth)


def fit(statistics: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees of labels.quality over at most train_rows labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    known = only(labels, "doc_id", "quality").where(F.col("quality").isNotNull()).withColumnRenamed("doc_id", "labelled")
    sample = known.where(fold("labelled", 5) != 0).orderBy(F.xxhash64("labelled"), "labelled").limit(train_rows)
    rows = statistics.join(sample, F.col("doc_id") == F.col("labelled")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("features", F.col("quality").cast("double")).collect()
    y = np.array([r[1] for r in rows])
    if len(rows) < 2 * LEAST or y.min() == y.max():
        return None
    return grow(np.array([r[0] for r in rows]), y, np.array([CONSTRAINTS.get(f, 0) for f in FEATURES]))


def _failed(base: np.ndarray) -> np.ndarray:
    n_words, repeat = base[:, BASE.index("n_words")], base[:, BASE.index("n_repeat_words")]
    return (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and probability (of the trees, that the quality is 1)."""
    statistics = cut(document_statistics(documents))
    forest = fit(statistics.select("doc_id", "features"), labels)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *BASE, "base_failed", "kept", "probability"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = _failed(np.stack([batch.column(c).to_numpy() for c in BASE], axis=1))
            p = forest.probabilities(matrix(batch.column("features"))) if forest else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in BASE), pa.array(failed), pa.array(~failed & (p >= ACCEPT)), pa.array(p)], names=names)

    return statistics.mapInArrow(judged, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, probability double")


def kept(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """documents that pass the base rules and the trees; the columns stay as they are.

    learn_from has the labelled texts to learn from, if documents were filtered before and lack the bad ones. The ids
    to learn from are at most train_rows, so they are broadcast and no text is shuffled.
    """
    known = only(labels, "doc_id", "quality").where(F.col("quality").isNotNull()).where(fold("doc_id", 5) != 0)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select(F.col("doc_id").alias("labelled"))
    source = documents if learn_from is None else learn_from
    texts = only(source, "doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"), "left_semi")
    forest = fit(document_statistics(texts).select("doc_id", "features"), labels, train_rows)

    def verdict(column: pa.Array) -> np.ndarray:
        base, features = text_statistics(column)
        good = ~_failed(base)
        return good & (forest.probabilities(features) >= ACCEPT) if forest else good

    return keep_rows(documents, verdict)
