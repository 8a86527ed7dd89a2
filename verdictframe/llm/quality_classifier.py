"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

The standardised document statistics are mapped to FEATURES_OUT cosines whose inner products approximate a Gaussian
kernel. Each partition sums its share of the normal equations over the labelled rows; the sums (one matrix of fixed
size a partition) are added up in a second stage, and only 16 such matrices come to the driver, which solves for the
weights. One labelled row in CALIBRATE (by a hash of its id) is kept out of the sums; the raw scores of these rows are
counted in BINS bins of equal width, over which pooling of adjacent violators fits the isotonic calibration. So the
calibration is fitted on rows that the weights have not seen. All labelled rows take part; there is no sample. Their
statistics are cut once, by a checkpoint.

Defined results: a null text counts as an empty one and gets a score like any other; labels that are null are
ignored, repeated labels count repeatedly; without any label every score is 0.5; with so few that one of the two parts
is empty, both take all rows. Ids, sources and languages are never
inputs of a score. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, fold, keep_rows, only, summed
from verdictframe.llm.statistics import FEATURES, document_statistics, matrix, text_statistics

FEATURES_OUT, WIDTH, RIDGE, BINS = 192, 3.0, 1e-3, 400
ACCEPT, CALIBRATE = 0.3, 4
LOW, HIGH = -0.5, 1.5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def cosines(self, features: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        w = rng.normal(0, 1 / WIDTH, (len(FEATURES), FEATURES_OUT))
        shift = rng.uniform(0, 2 * np.pi, FEATURES_OUT)
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES_OUT) * np.cos(x @ w + shift), np.ones((len(x), 1))], axis=1)

    def bins(self, features: np.ndarray) -> np.ndarray:
        raw = np.concatenate([self.cosines(part) @ self.weights for part in np.array_split(features, 1 + len(features) // 4096)])
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.calibrated is None:
            return np.full(len(features), 0.5)
        return self.calibrated[self.bins(features)]


def isotonic(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing shares nearest to ones / n, by pooling adjacent violators; gaps take the line between."""
    at = np.flatnonzero(n)
    pools: list[list[float]] = []
    for i in at:
        pools.append([ones[i], n[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    values = np.repeat([a / b for a, b, _ in pools], [c for *_, c in pools])
    return np.interp(np.arange(len(n)), at, values)


def fit(statistics: DataFrame, labels: DataFrame, use: Column) -> Model:
    """The model of labels.quality over the labelled rows for which use holds; statistics as of document_statistics."""
    known = only(labels, "doc_id", "quality").where(F.col("quality").isNotNull()).withColumnRenamed("doc_id", "labelled")
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0).alias("held")
    train = cut(statistics.select("doc_id", "features").where(use).join(known, F.col("doc_id") == F.col("labelled")).select("features", F.col("quality").cast("double").alias("y"), held))
    sizes = {r["held"]: r["n"] for r in train.groupBy("held").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = len(sizes) == 2
    to_solve, to_calibrate = (train.where(F.col("held") == h) if apart else train for h in (False, True))
    d = len(FEATURES)
    moments = to_solve.select(F.posexplode("features").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale")).collect()
    model = Model(np.zeros(d), np.ones(d))
    if not moments:
        return model
    for r in moments:
        model.mean[r["at"]], model.scale[r["at"]] = r["mean"], r["scale"] if r["scale"] > 1e-9 else 1.0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES_OUT + 1, FEATURES_OUT + 2))
        for batch in batches:
            z = model.cosines(matrix(batch.column(0)))
            total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    total = summed(to_solve.select("features", "y").mapInArrow(equations, "k string, v binary"), "k", "v")["sum"].reshape(FEATURES_OUT + 1, FEATURES_OUT + 2)
    a, b = total[:, :-1], total[:, -1]
    ridge = RIDGE * a[-1, -1] * np.eye(len(a)) / FEATURES_OUT
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(a + ridge + 1e-9 * np.eye(len(a)), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.bins(matrix(batch.column(0)))), batch.column(1)], names=["bin", "y"])

    counts = to_calibrate.select("features", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).collect()
    ones, n = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        ones[r["bin"]], n[r["bin"]] = r["ones"], r["n"]
    model.calibrated = isotonic(ones, n)
    return model


def learned_fold() -> Column:
    """Rows from which labels may be learned: those whose crc32(doc_id) mod 5 isn't 0."""
    return fold("doc_id", 5) != 0


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, held_out, score and predicted."""
    statistics = cut(document_statistics(documents).select("doc_id", "features"))
    model = fit(statistics, labels, learned_fold())
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(matrix(batch.column(1))))], names=["doc_id", "score"])

    return statistics.mapInArrow(scored, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents whose score is at least ACCEPT; the columns stay as they are.

    The texts are read twice, once for the statistics from which the model learns and once to be scored: only
    statistics meet the labels in a shuffle, never texts.
    """
    model = fit(cut(document_statistics(documents).select("doc_id", "features")), labels, learned_fold())
    return keep_rows(documents, lambda column: model.scores(text_statistics(column)[1]) >= ACCEPT)
