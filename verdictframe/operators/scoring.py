"""Scoring: one projection over the samples, one row a sample and scorer, and the statistics of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scorers import MINIMIZE, SCORERS, Scorer
from verdictframe.operators.splits import ordinal

UNKNOWN, NOT_TESTED = "unknown", "not_tested"


def score(samples: DataFrame, scorers: Sequence[Scorer | str], keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Tall scores of samples: the kept columns, score_no, name, value, direction and status.

    All scorers are columns of one projection, so a run is one scan. A score that its sample lacks the columns for
    has no row; one that couldn't be measured has a null value and status 'unknown'.
    """
    chosen = [SCORERS[s] if isinstance(s, str) else s for s in scorers]
    rows = F.array(*(F.struct(F.lit(k).alias("score_no"), F.lit(s.name).alias("name"), s.column().cast("double").alias("value"), F.lit(s.direction).alias("direction"), _applies(s).alias("applies")) for k, s in enumerate(chosen)))
    tall = samples.select(*keep, F.inline(rows))
    return tall.where("applies").drop("applies").withColumn("status", F.when(F.col("value").isNull(), F.lit(UNKNOWN)))


def _applies(scorer: Scorer) -> Column:
    found = F.lit(True)
    for c in scorer.required:
        found = found & F.col(c).isNotNull()
    return found


def measured(scores: DataFrame) -> DataFrame:
    """Scores that are measurements: a status keeps a row out of every average."""
    return scores.where("status is null and value is not null")


def statistics(scores: DataFrame, *by: str) -> DataFrame:
    """n, mean, std (population), stderr, min and max of each group; a group of one has a std and stderr of 0."""
    n = F.count("value")
    std = F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    return measured(scores).groupBy(*by).agg(
        n.alias("n"), F.avg("value").alias("mean"), std.alias("std"), F.when(n < 2, F.lit(0.0)).otherwise(std / F.sqrt(n)).alias("stderr"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def percentiles(values: DataFrame, by: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: a column p<point> for each of the points (0 to 100)."""
    return values.groupBy(*by).agg(*(F.percentile(column, p / 100).alias(f"p{p:g}") for p in points))


def indexed_percentiles(values: DataFrame, by: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """Percentiles that take the value at place int(p/100 * (n-1)) of the sorted values, without interpolation.

    The values of all groups are range-partitioned together and numbered, so that a large group is sorted by many
    tasks; the places wanted are a row a group and point.
    """
    numbered = ordinal(values.where(F.col(column).isNotNull()).select(*by, column), *by, column)
    groups = numbered.groupBy(*by).agg(F.min("row_no").alias("start__"), F.count(F.lit(1)).alias("n__"))
    wanted = F.array(*(F.struct(F.lit(f"p{p:g}").alias("point__"), (F.col("start__") + F.floor(F.lit(p / 100) * (F.col("n__") - 1))).alias("at__")) for p in points))
    picked = numbered.select("row_no", *by, column).join(groups.select(F.inline(wanted)), F.col("row_no") == F.col("at__"))
    return picked.groupBy(*by).agg(*(F.max(F.when(F.col("point__") == f"p{p:g}", F.col(column))).alias(f"p{p:g}") for p in points))


def unscored(scores: DataFrame, *by: str) -> DataFrame:
    """How many scores of each group are unknown and not tested."""
    return scores.groupBy(*by).agg(F.count_if(F.col("status") == UNKNOWN).alias("unknown"), F.count_if(F.col("status") == NOT_TESTED).alias("not_tested"))


def passed(value: Column, threshold: Column, direction: Column) -> Column:
    """Whether a gated score holds its threshold; null without a threshold."""
    return F.when(threshold.isNotNull(), F.when(direction == MINIMIZE, value <= threshold).otherwise(value >= threshold))


def correctness(scores: DataFrame, *sample: str) -> DataFrame:
    """Per sample: the primary score (its first) and correct.

    correct is false when a score is unknown, else what the gate of the primary says, else whether the primary is
    exactly 1 (0 when lower is better); null without a score. scores may have a column threshold.
    """
    if "threshold" not in scores.columns:
        scores = scores.withColumn("threshold", F.lit(None).cast("double"))
    first = F.min_by(F.struct("value", "direction", "threshold", "status"), "score_no").alias("p")
    grouped = scores.groupBy(*sample).agg(first, F.bool_or(F.coalesce(F.col("status") == UNKNOWN, F.lit(False))).alias("failed"))
    value, direction = F.col("p.value"), F.col("p.direction")
    exact = F.when(direction == MINIMIZE, value == 0.0).otherwise(value == 1.0)
    correct = F.when(F.col("failed"), F.lit(False)).when(value.isNotNull(), F.coalesce(passed(value, F.col("p.threshold"), direction), exact))
    return grouped.select(*sample, value.alias("score"), correct.alias("correct"))


def weighted_sum(scores: DataFrame, *sample: str) -> DataFrame:
    """Weighted mean of each sample's measured scores (column weight); null when nothing is measured."""
    ok = F.col("status").isNull() & F.col("value").isNotNull()
    total, weight = F.sum(F.when(ok, F.col("value") * F.col("weight"))), F.sum(F.when(ok, F.col("weight")))
    return scores.groupBy(*sample).agg(F.try_divide(total, F.when(weight != 0, weight)).alias("weighted"))


def failed_zeros(scores: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of 0 for the samples in failed (sample_id), for every score to maximise that all scored samples have."""
    n = scores.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("n_samples"))
    everywhere = scores.where("direction = 'maximize'").groupBy("name").agg(F.count_distinct("sample_id").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n_samples")).select("name")
    zeros = failed.select("sample_id").distinct().join(F.broadcast(everywhere)).withColumn("value", F.lit(0.0))
    return zeros.join(scores.select("sample_id", "name"), ["sample_id", "name"], "left_anti")


def macro_average(scores: DataFrame, task: str = "task", name: str = "name") -> DataFrame:
    """Mean over tasks of the tasks' means."""
    per_task = measured(scores).groupBy(name, task).agg(F.avg("value").alias("task_mean"))
    return per_task.groupBy(name).agg(F.avg("task_mean").alias("macro"), F.count(F.lit(1)).alias("n_tasks"))


def throughput(calls: DataFrame, *by: str) -> DataFrame:
    """Requests a second of calls (elapsed_ms, n_served); 0 without elapsed time."""
    seconds = F.sum("elapsed_ms") / 1000
    return calls.groupBy(*by).agg(F.sum("n_served").alias("n_served"), F.coalesce(F.try_divide(F.sum("n_served"), F.when(seconds > 0, seconds)), F.lit(0.0)).alias("per_second"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k drawn trials of n, c of them right, is right: 1 - C(n-c, k) / C(n, k)."""
    misses = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1 - misses)


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """Chance that all of k drawn trials are right: C(c, k) / C(n, k)."""
    hits = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(c < k, F.lit(0.0)).otherwise(hits)
