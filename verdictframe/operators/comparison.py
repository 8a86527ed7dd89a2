"""Comparison of runs: joins of their scores and statistics, graded changes, leaderboards and significance."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdictframe.functions.scorers import MAXIMIZE, MINIMIZE
from verdictframe.operators.scoring import measured
from verdictframe.operators.splits import group_ordinal

WARN, FAIL = 0.02, 0.05
#: From best to worst; a group's grade is its worst.
GRADES = ["not_comparable", "pass", "warn", "fail"]


def last_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def score_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """sample_id, baseline and candidate where both runs (sample_id, row_no, score) measured the sample."""
    a, b = (last_wins(x, ["sample_id"], "row_no").where("score is not null").select("sample_id", F.col("score").alias(n)) for x, n in ((baseline, "baseline"), (candidate, "candidate")))
    return a.join(b, "sample_id")


def change(before: Column, after: Column) -> Column:
    """Class of a sample's change between two runs' correctness; unknown where either is missing."""
    return (
        F.when(before.isNull() | after.isNull(), "unknown").when(before & ~after, "regressed").when(~before & after, "improved").when(before & after, "still_correct").otherwise("still_wrong")
    )


def sample_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """sample_id, before, after and change of two runs (sample_id, row_no, correct)."""
    a, b = (last_wins(x, ["sample_id"], "row_no").select("sample_id", F.col("correct").alias(n)) for x, n in ((baseline, "before"), (candidate, "after")))
    return a.join(b, "sample_id", "full_outer").withColumn("change", change(F.col("before"), F.col("after")))


CHANGES = ["regressed", "improved", "still_correct", "still_wrong", "unknown"]


def sample_summary(diff: DataFrame) -> DataFrame:
    """One row: how many samples are in each of the five classes, zeros included."""
    return diff.agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))


def regression(delta: Column, direction: Column) -> Column:
    """How much worse a change of a mean is, whichever way its metric points."""
    return F.when(direction == MINIMIZE, delta).otherwise(-delta)


def grade(delta: Column, direction: Column, warn: float = WARN, fail: float = FAIL) -> Column:
    worse = regression(delta, direction)
    return F.when(delta.isNull(), "not_comparable").when(worse >= fail, "fail").when(worse >= warn, "warn").otherwise("pass")


def first_directions(scores: DataFrame, order: str) -> DataFrame:
    """name and direction: the first direction that each metric's scores say, in the order of a column; an unknown one is to maximise."""
    said = scores.where("direction is not null").groupBy("name").agg(F.min_by("direction", order).alias("direction"))
    return said.withColumn("direction", F.when(F.col("direction") == MINIMIZE, MINIMIZE).otherwise(MAXIMIZE))


def with_direction(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """rows (name) with direction: the metric's own, else that of the metric behind a "task:" prefix, else to maximise.

    directions has a row a metric, so it is broadcast.
    """
    own, base = (directions.select(F.col("name").alias(n), F.col("direction").alias(f"{n}_direction")) for n in ("own__", "base__"))
    stripped = F.when(F.contains("name", F.lit(":")), F.regexp_replace("name", "^[^:]*:", "")).otherwise(F.col("name"))
    joined = rows.join(F.broadcast(own), F.col("name") == F.col("own__"), "left").join(F.broadcast(base), stripped == F.col("base__"), "left")
    return joined.withColumn("direction", F.coalesce("own___direction", "base___direction", F.lit(MAXIMIZE))).drop("own__", "base__", "own___direction", "base___direction")


def worst_grade(grades: Column) -> Column:
    """The worst of a group's grades; not_comparable for an empty group."""
    rank = F.max(F.array_position(F.array(*(F.lit(g) for g in GRADES)), grades))
    return F.coalesce(F.element_at(F.array(*(F.lit(g) for g in GRADES)), rank.cast("int")), F.lit("not_comparable"))


def metric_deltas(baseline: DataFrame, candidate: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Full outer join of two runs' statistics (the by columns, mean, n): both means, both counts, delta."""
    a, b = (x.select(*by, F.col("mean").alias(f"{n}_mean"), F.col("n").alias(f"{n}_n")) for x, n in ((baseline, "baseline"), (candidate, "candidate")))
    return a.join(b, list(by), "full_outer").withColumn("delta", F.col("candidate_mean") - F.col("baseline_mean"))


def relative_pct(delta: Column, base: Column) -> Column:
    """Change in per cent of the base; null unless the base is above 0."""
    return F.when(base > 0, delta / base * 100)


def retention(candidate: Column, baseline: Column) -> Column:
    """candidate / baseline; NaN for negative values or a base of 0."""
    return F.when((baseline <= 0) | (candidate < 0), F.lit(float("nan"))).otherwise(F.try_divide(candidate, baseline))


def leaderboard(scores: DataFrame, missing_last: bool = False) -> DataFrame:
    """place of each run (run_no, value): descending, a missing value as 0, or last; ties keep the runs' order."""
    value = F.col("value").desc_nulls_last() if missing_last else F.coalesce("value", F.lit(0.0)).desc()
    return scores.withColumn("place", F.row_number().over(Window.orderBy(value, "run_no")).cast("long"))


def best_model(scores: DataFrame, by: Sequence[str], minimize: bool = False) -> DataFrame:
    """The best model of each group (model, model_no, value); among equals the one listed first."""
    order = F.col("value").asc() if minimize else F.col("value").desc()
    w = Window.partitionBy(*by).orderBy(order, "model_no")
    return scores.where("value is not null").withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def model_deltas(statistics: DataFrame) -> DataFrame:
    """Per metric and ordered pair of models: the difference of their means, to four places."""
    a = statistics.select("name", F.col("model").alias("model_a"), F.col("mean").alias("mean_a"))
    b = statistics.select("name", F.col("model").alias("model_b"), F.col("mean").alias("mean_b"))
    return a.join(b, "name").where("model_a <> model_b").select("name", "model_a", "model_b", F.round(F.col("mean_a") - F.col("mean_b"), 4).alias("delta"))


def comparison_table(statistics: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row a metric: each model's score, n and std, and the winner (the first of the best)."""
    wide = statistics.groupBy("name").pivot("model", list(models)).agg(F.first("mean").alias("score"), F.first("n").alias("n"), F.first("std").alias("std"))
    values = F.array(*(F.col(f"`{m}_score`") for m in models))
    winner = F.element_at(F.array(*(F.lit(m) for m in models)), F.array_position(values, F.array_max(values)).cast("int"))
    return wide.withColumn("winner", winner)


def _check_resampling(n_resamples: int, confidence: float) -> None:
    if n_resamples < 1:
        raise ValueError(f"n_resamples must be at least 1, not {n_resamples}")
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must lie between 0 and 1, not {confidence}")


#: Differences this near to each other, or to zero, count as equal, beside a change of this size.
TIE = 1e-9
#: Fixed value: a change with a smaller p-value is significant.
SIGNIFICANT = 0.05
BOOTSTRAP = "n long, mean_baseline double, mean_candidate double, delta double, ci_low double, ci_high double, p_value double, significant boolean"


#: So many pairs of a group make up one block of resampling.
BLOCK_PAIRS = 1 << 16
#: About so many draws of a block stand in memory at once, or those of one resample.
DRAWS_AT_ONCE = 1 << 21


def block_counts(sizes: np.ndarray, block: int, n_resamples: int, seed: int) -> np.ndarray:
    """How many of n draws with replacement fall into a block, for each resample, n being the sum of sizes.

    The draws are split down a binary tree over the blocks by binomial shares. Each node has a stream of its own that
    follows from the seed and the node, so all blocks agree on the counts without knowing of each other.
    """
    lo, hi = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    left = np.full(n_resamples, total[-1])
    while hi - lo > 1:
        middle = (lo + hi) // 2
        share = (total[middle] - total[lo]) / (total[hi] - total[lo])
        drawn = np.random.default_rng([seed, lo, hi]).binomial(left, share)
        lo, hi, left = (lo, middle, drawn) if block < middle else (middle, hi, left - drawn)
    return left


def block_sums(values: np.ndarray, draws: np.ndarray, seed: int, block: int) -> np.ndarray:
    """Sums of so many draws with replacement from a block's values, for each resample."""
    stream, out = np.random.default_rng([seed, block, 1 << 40]), np.zeros(len(draws))
    part = np.cumsum(draws) // DRAWS_AT_ONCE  # the stream goes on from part to part, so parts of any size pick the same values
    for at in np.split(np.arange(len(draws)), np.flatnonzero(np.diff(part)) + 1) if len(values) else ():
        ends = np.cumsum(draws[at])
        running = np.concatenate([[0.0], np.cumsum(values[stream.integers(0, len(values), int(ends[-1]))])])
        out[at] = running[ends] - running[ends - draws[at]]
    return out


def stream_sums(values: np.ndarray, n_resamples: int, seed: int) -> np.ndarray:
    """Sums of n_resamples resamples of all values, picked by one seeded stream of random.Random(seed).randrange(len(values)).

    The generator's words are taken in bulk: a pick is a word's leading bits, and words that are too large are passed over.
    """
    n, (_, words, _) = len(values), random.Random(seed).getstate()
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint32), "pos": words[-1]}}
    shift, out, held = np.uint64(32 - n.bit_length()), np.empty(n_resamples), np.zeros(0, np.int64)
    step = max(1, (1 << 21) // n)
    for first in range(0, n_resamples, step):
        k = min(step, n_resamples - first)
        while len(held) < k * n:
            drawn = (generator.random_raw(int((k * n - len(held)) * 1.1) + 64).astype(np.uint64) >> shift).astype(np.int64)
            held = np.concatenate([held, drawn[drawn < n]])
        out[first : first + k] = values[held[: k * n].reshape(k, n)].sum(1)
        held = held[k * n :]
    return out


def paired_bootstrap(pairs: DataFrame, by: Sequence[str], n_resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Exact paired bootstrap of each group's (baseline, candidate) pairs: both means, delta, interval, two-sided p-value.

    A resample draws as many pairs as the group has, with replacement. A group of up to BLOCK_PAIRS pairs is drawn by one
    seeded stream. The draws of a larger one are first dealt to blocks of BLOCK_PAIRS pairs (in the order of sample_id)
    by exact binomial splits, then drawn inside each block, so a resample is a sum over blocks. A task holds one block
    and a vector of n_resamples sums, and vectors are added up by group. The result follows from the pairs, the order of their ids and the seed. Ties with the observed change count as
    extreme, the interval is interpolated, fewer than two pairs give nulls.
    """
    _check_resampling(n_resamples, confidence)
    names = [part.split()[0] for part in BOOTSTRAP.split(", ")]
    keys = [f"by{i}__" for i in range(len(by))]
    plain = pairs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), "sample_id", F.col("baseline").cast("double").alias("baseline"), F.col("candidate").cast("double").alias("candidate"))
    placed = group_ordinal(plain, keys, "sample_id", "baseline", "candidate").withColumn("block__", F.floor(F.col("place") / BLOCK_PAIRS).cast("int"))
    types = ", ".join(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        n, block = int(pdf["size"].iloc[0]), int(pdf["block__"].iloc[0])
        sizes = np.minimum(BLOCK_PAIRS, n - np.arange(0, n, BLOCK_PAIRS))
        a, b = pdf["baseline"].to_numpy(), pdf["candidate"].to_numpy()
        v = stream_sums(b - a, n_resamples, seed) if len(sizes) == 1 else block_sums(b - a, block_counts(sizes, block, n_resamples, seed), seed, block)
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": len(pdf), "a": math.fsum(a), "b": math.fsum(b), "d": math.fsum(b - a), "v": v}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    partial = placed.groupBy(*keys, "block__").applyInPandas(sums, f"{types}, n long, a double, b double, d double, v array<double>")
    # vectors are added up by place in a few steps, so that no task holds more than a bounded number of them
    spread = partial.withColumn("at__", F.pmod(F.xxhash64("a", "b", "d"), F.lit(ADD_TASKS))).select(*keys, "at__", "n", "a", "b", "d", "v")

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", "a", "b"], kind="stable")
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": int(pdf["n"].sum()), **{c: math.fsum(pdf[c]) for c in "abd"}, "v": np.sum(np.stack(pdf["v"].tolist()), axis=0)}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        row = added(pdf).iloc[0]
        n = int(row["n"])
        found = (n, *[None] * 7)
        if n >= 2:
            observed, means = row["d"] / n, np.asarray(row["v"]) / n
            least = abs(observed) - TIE * max(1.0, abs(observed))
            tail, p = (1 - confidence) / 2, (int((np.abs(means - observed) >= least).sum()) + 1) / (n_resamples + 1)
            low, high = np.quantile(means, [tail, 1 - tail])
            found = (n, row["a"] / n, row["b"] / n, observed, float(low), float(high), p, p < SIGNIFICANT)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{k: [v] for k, v in zip(names, found, strict=True)}})

    summed = spread.groupBy(*keys, "at__").applyInPandas(added, f"{types}, n long, a double, b double, d double, v array<double>")
    done = summed.groupBy(*keys).applyInPandas(closed, f"{types}, {BOOTSTRAP}")
    return done.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *names)


#: Vectors of a group's blocks are added up by so many tasks first.
ADD_TASKS = 32


#: Cumulative shares of Poisson(1).
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119])


def poisson_weights(keys: np.ndarray, n_resamples: int) -> np.ndarray:
    """keys x resamples: how often each key is drawn, from a hash of the key and the resample's number."""
    x = keys.astype(np.uint64)[:, None] + np.arange(1, n_resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_POISSON, u, side="right")


def poisson_bootstrap(pairs: DataFrame, by: Sequence[str], n_resamples: int = 200, confidence: float = 0.95) -> DataFrame:
    """Approximate paired bootstrap for groups of any size: each row gets a Poisson(1) weight in each resample.

    Weights come from a hash of the sample and the resample's number, so they don't depend on partitions. Each task
    sums its rows to one vector of n_resamples weights and one of weighted differences a group; only these are shuffled.
    """
    _check_resampling(n_resamples, confidence)
    rows = pairs.select(*by, F.xxhash64("sample_id").alias("key__"), (F.col("candidate") - F.col("baseline")).cast("double").alias("d__"))
    keys = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = list(zip(*(c.to_pylist() for c in batch.columns[:-2]), strict=True)) if by else [()] * batch.num_rows
            key, d = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                at.setdefault(g, []).append(i)
            for g, places in at.items():
                for lo in range(0, len(places), 4096):
                    part = places[lo : lo + 4096]
                    w = poisson_weights(key[part], n_resamples)
                    x = np.stack([w.sum(0), d[part] @ w, np.full(n_resamples, len(part)), np.full(n_resamples, d[part].sum())])
                    total[g] = total[g] + x if g in total else x
        for g, x in total.items():
            columns = [pa.array([v] * n_resamples, t) for v, t in zip(g, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n_resamples)), *(pa.array(r.astype(float)) for r in x)], names=[*by, "b", "w", "wd", "n", "d"])

    kinds = [to_arrow_type(pairs.schema[c].dataType) for c in by]
    partial = rows.mapInArrow(sums, f"{keys}{', ' if by else ''}b long, w double, wd double, n double, d double")
    means = partial.groupBy(*by, "b").agg(F.try_divide(F.sum("wd"), F.sum("w")).alias("m"), (F.sum("d") / F.sum("n")).alias("observed"), F.sum("n").cast("long").alias("n"))
    extreme = F.count_if(F.abs(F.col("m") - F.col("observed")) >= F.abs("observed") - TIE * F.greatest(F.lit(1.0), F.abs("observed")))
    tail = (1 - confidence) / 2
    return means.groupBy(*by).agg(
        F.max("n").alias("n"), F.first("observed").alias("delta"), F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"), ((extreme + 1) / (n_resamples + 1)).alias("p_value")
    )


def coverage_warnings(baseline: DataFrame, candidate: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Groups whose counts differ between two runs' statistics, with the kind of difference."""
    joined = metric_deltas(baseline, candidate, by)
    kind = F.when(F.col("baseline_n").isNull(), "only_candidate").when(F.col("candidate_n").isNull(), "only_baseline").otherwise("count_differs")
    return joined.where(~F.col("baseline_n").eqNullSafe(F.col("candidate_n"))).select(*by, "baseline_n", "candidate_n", kind.alias("warning"))


def per_task(scores: DataFrame) -> DataFrame:
    return measured(scores).groupBy("task", "name").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"))


def cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """run_id and cost of runs' token usage (run_id, model, prompt_tokens, completion_tokens) at prices a million tokens."""
    joined = usage.join(pricing, "model", "left")
    return joined.select("run_id", (F.col("prompt_tokens") / 1e6 * F.col("prompt_price") + F.col("completion_tokens") / 1e6 * F.col("completion_price")).alias("cost"))


def significance(pairs: DataFrame, by: Sequence[str], **settings) -> DataFrame:
    """paired_bootstrap() with the change counted from the candidate to the baseline: delta negated, interval negated and swapped."""
    found = paired_bootstrap(pairs, by, **settings)
    return found.select(*by, "n", "mean_baseline", "mean_candidate", (0.0 - F.col("delta")).alias("delta"), (0.0 - F.col("ci_high")).alias("ci_low"), (0.0 - F.col("ci_low")).alias("ci_high"), "p_value", "significant")
