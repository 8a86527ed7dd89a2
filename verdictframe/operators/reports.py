"""Reports over runs, agents and experiments: what a finished evaluation is summed up by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.scorers import MINIMIZE

#: Reasons for which a generation ended without an answer.
NO_ANSWER = ("length", "error", "abort", "content_filter")


def no_answer(incorrect: Column, reason: Column) -> Column:
    """Whether a wrong sample is one that the model never answered, by the reason why generation ended."""
    return incorrect & F.coalesce(reason.isin(*NO_ANSWER), F.lit(False))


def token_usage(calls: DataFrame, by: str, tokens: Column) -> DataFrame:
    """total_tokens and n_calls of each group; calls that don't say count as none."""
    return calls.groupBy(by).agg(F.sum(F.coalesce(tokens, F.lit(0).cast("long"))).alias("total_tokens"), F.count(F.lit(1)).alias("n_calls"))


def token_throughput(calls: DataFrame, by: str, tokens: Column, elapsed_ms: Column) -> DataFrame:
    """tokens_per_second of each group; 0 without elapsed time."""
    seconds = F.sum(elapsed_ms) / 1000
    return calls.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(tokens), F.when(seconds > 0, seconds)), F.lit(0.0)).alias("tokens_per_second"))


def error_census(errors: DataFrame, by: str = "metric") -> DataFrame:
    """n_errors of each group of failed scores."""
    return errors.groupBy(by).agg(F.count(F.lit(1)).alias("n_errors"))


def route_distribution(routes: DataFrame) -> DataFrame:
    """route_no, decided_by and n: which route the episodes with several took, and what decided.

    routes is as of agents.best_route(). Information, not a score: episodes with one route don't count.
    """
    return routes.where("n_routes > 1").groupBy("route_no", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def disagreement(verdicts: DataFrame, by: str, kind: Column | None = None) -> DataFrame:
    """Per group of (one, other) verdicts: disagreement_rate over those where both are known, n_disagree, and a map of kinds.

    A kind is 'one->other' of a disagreement, unless another is given.
    """
    known = F.col("one").isNotNull() & F.col("other").isNotNull()
    differ = known & (F.col("one") != F.col("other"))
    named = F.concat_ws("->", "one", "other") if kind is None else kind
    each = verdicts.groupBy(by, F.when(differ, named).alias("kind")).agg(F.count_if(known).alias("known"), F.count_if(differ).alias("k"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("kind", "k")))))
    return each.groupBy(by).agg(F.coalesce(F.try_divide(F.sum("k"), F.sum("known")), F.lit(0.0)).alias("disagreement_rate"), F.sum("k").alias("n_disagree"), kinds.alias("kinds"))


def agent_summary(rows: DataFrame, by: str) -> DataFrame:
    """Per group of trials (verdict, status, coverage, latency): counts of each, and the median latency."""
    verdicts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("success", "failure", "unknown", "error")]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *verdicts, F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("coverage") == "full").alias("n_full"), F.median("latency").alias("median_latency"))


def experiment_mean(scores: DataFrame, experiment: str, run: str, value: str) -> DataFrame:
    """mean_headline of each experiment: the mean of its runs' means."""
    headline = scores.groupBy(experiment, run).agg(F.avg(value).alias("headline"))
    return headline.groupBy(experiment).agg(F.avg("headline").alias("mean_headline"))


def harness_results(results: DataFrame, task: str, column: str = "results") -> DataFrame:
    """name ('task:metric') and value of another harness' results: a map of 'metric,filter' keys; standard errors are left out."""
    each = results.select(task, F.explode(column).alias("key", "value")).where(~F.substring_index("key", ",", 1).endswith("_stderr"))
    return each.select(F.concat_ws(":", task, F.substring_index("key", ",", 1)).alias("name"), "value")


def first_failing_stage(checks: DataFrame, by: str) -> DataFrame:
    """first_failing: the earliest stage of each group's checks (stage, failed) that failed; groups without one have no row."""
    return checks.where("failed").groupBy(by).agg(F.min("stage").alias("first_failing"))


def pass_rates(results: DataFrame, *by: str) -> DataFrame:
    """n, passed and pass_rate (results has passed) of each group and of all."""
    n, good = F.count(F.lit(1)), F.count_if("passed")
    return results.rollup(*by).agg(n.alias("n"), good.alias("passed"), (good / n).alias("pass_rate"))


def eligibility(counts: DataFrame, needs: Mapping[str, Column]) -> DataFrame:
    """counts with missing: the first of the needs (name: whether it is there) that an episode lacks, null if it has all."""
    missing = F.lit(None).cast("string")
    for name, there in reversed(list(needs.items())):
        missing = F.when(~F.coalesce(there, F.lit(False)), F.lit(name)).otherwise(missing)
    return counts.withColumn("missing", missing)


def at_least(rates: DataFrame, column: str, least: float) -> DataFrame:
    """The rows whose rate is at least so high."""
    return rates.where(F.col(column) >= least)


def lineage_conflicts(rows: DataFrame, source: str, column: str, strict: bool = False) -> DataFrame:
    """Sources with several values of a column, and how many; strict: any of them raises."""
    found = rows.groupBy(source).agg(F.count_distinct(column).alias("n_values")).where("n_values > 1")
    return refuse(found, source, f"sources with several values of {column}") if strict else found


def duplicates(rows: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Keys that several rows have, and how many; strict: any of them raises."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return refuse(found, key, f"rows with the same {key}") if strict else found


def refuse(found: DataFrame, key: str, what: str) -> DataFrame:
    """found, if it is empty; else a ValueError that names some of its keys."""
    some = [str(r[0]) for r in found.select(key).limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(some)}")
    return found


def unpaired(results: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """unpaired: how many results have no call."""
    return results.select(key).join(calls.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unpaired"))


def per_metric(statistics: DataFrame) -> DataFrame:
    """statistics (name, model, mean, n, std) with score and place: the models of each metric from best to worst, ties by name."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("mean"), "model")).cast("long")
    return statistics.select("name", "model", F.col("mean").alias("score"), "n", "std", place.alias("place"))


def performance_table(calls: DataFrame, by: str, ms: str) -> DataFrame:
    """n_calls, mean_ms, p95_ms and per_second of each group of calls."""
    n = F.count(F.lit(1))
    return calls.groupBy(by).agg(n.alias("n_calls"), F.avg(ms).alias("mean_ms"), F.percentile(ms, 0.95).alias("p95_ms"), F.try_divide(n, F.sum(ms) / 1000).alias("per_second"))


def cost_table(usage: DataFrame, pricing: DataFrame, by: str = "model") -> DataFrame:
    """prompt_tokens, completion_tokens, cost (null without a price) and share of the whole cost of each model."""
    summed = usage.groupBy(by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    priced = summed.join(pricing, by, "left").withColumn("cost", F.col("prompt_tokens") / 1e6 * F.col("prompt_price") + F.col("completion_tokens") / 1e6 * F.col("completion_price"))
    total = F.sum("cost").over(Window.partitionBy(F.lit(1)))
    return priced.select(by, "prompt_tokens", "completion_tokens", "cost", F.try_divide(F.col("cost"), total).alias("cost_share"))


def size_table(models: DataFrame, baseline: str) -> DataFrame:
    """models (model, size) with size_ratio to the baseline's size; null where either is missing."""
    base = models.where(F.col("model") == baseline).agg(F.max("size").alias("base__"))
    return models.crossJoin(F.broadcast(base)).select("model", "size", F.try_divide(F.col("size"), F.col("base__")).alias("size_ratio"))


def tradeoff(models: DataFrame, baseline: str, score: str = "score", size: str = "size", per_second: str = "per_second") -> DataFrame:
    """Each model (one row each) against the baseline: retention of its score, size_ratio and speedup; NaN for a score that can't be compared."""
    base = models.where(F.col("model") == baseline).agg(*(F.max(c).alias(f"base_{k}") for k, c in (("score", score), ("size", size), ("speed", per_second))))
    from verdictframe.operators.comparison import retention

    joined = models.where(F.col("model") != baseline).crossJoin(F.broadcast(base))
    return joined.select("model", retention(F.col(score), F.col("base_score")).alias("retention"), F.try_divide(F.col(size), F.col("base_size")).alias("size_ratio"), F.try_divide(F.col(per_second), F.col("base_speed")).alias("speedup"))


def failure_summary(predictions: DataFrame, by: str = "model") -> DataFrame:
    """Per group of predictions (correct, reason, error): n, n_wrong, n_no_answer, n_errors and the failure_rate."""
    wrong = ~F.coalesce(F.col("correct"), F.lit(False))
    n = F.count(F.lit(1))
    return predictions.groupBy(by).agg(n.alias("n"), F.count_if(wrong).alias("n_wrong"), F.count_if(no_answer(wrong, F.col("reason"))).alias("n_no_answer"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), (F.count_if(wrong) / n).alias("failure_rate"))


def pairwise(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """model_a, model_b, wins, losses and ties over the samples that both scored (sample_id, model, value, direction)."""
    a = scores.where("value is not null").select("sample_id", "name", F.col("model").alias("model_a"), F.col("value").alias("a"), "direction")
    b = scores.where("value is not null").select("sample_id", "name", F.col("model").alias("model_b"), F.col("value").alias("b"))
    order = F.array(*map(F.lit, models))
    both = a.join(b, ["sample_id", "name"]).where(F.array_position(order, F.col("model_a")) < F.array_position(order, F.col("model_b")))
    ahead = F.when(F.col("direction") == MINIMIZE, F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return both.groupBy("name", "model_a", "model_b").agg(F.count_if(ahead > 0).alias("wins"), F.count_if(ahead < 0).alias("losses"), F.count_if(ahead == 0).alias("ties"))


def summary_text(statistics: DataFrame, title: str) -> str:
    """A Markdown table of a run's statistics, a row a metric; there are as many rows as metrics."""
    rows = statistics.orderBy("name").collect()
    lines = [f"# {title}", "", "| metric | n | mean | std |", "|---|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['name']} | {r['n']} | {r['mean']:.4f} | {r['std']:.4f} |" for r in rows)]) + "\n"


def recorded_only(rows: DataFrame) -> DataFrame:
    """The rows of recorded results: those that are tasks to run (is_task) aren't scored."""
    return rows.where(~F.coalesce(F.col("is_task"), F.lit(False)))


#: Scorers by what of an episode must have been observed, each group by all of its needs.
SUPPORTED = [
    (("tool_call_names", "tool_call_arguments"), (), ["tool_call_f1", "trajectory_match", "tool_call_validity", "redundant_tool_calls"]),
    (("tool_call_names", "tool_call_arguments", "parallel_grouping"), (), ["parallel_tool_calls"]),
    (("tool_call_names",), ("tool_call_arguments",), ["tool_call_f1_name", "tool_call_validity"]),
    (("retrieved_contexts",), (), ["retrieval"]),
]


def supported_scorers(coverage: Column) -> Column:
    """Which scorers an episode can feed, by its coverage (a map of parts to observed, missing or inferred)."""

    def seen(part: str) -> Column:
        return F.coalesce(F.try_element_at(coverage, F.lit(part)) == "observed", F.lit(False))

    out = F.array(F.lit("task_completion"))
    for needs, lacks, scorers in SUPPORTED:
        holds = F.lit(True)
        for part in needs:
            holds = holds & seen(part)
        for part in lacks:
            holds = holds & ~seen(part)
        out = F.concat(out, F.when(holds, F.array(*map(F.lit, scorers))).otherwise(F.array().cast("array<string>")))
    return out


def event_coverage(label: Column, events: Column) -> Column:
    """observed, missing or inferred: an explicit label wins; a null list was never captured, an empty one was."""
    return F.coalesce(label, F.when(events.isNull(), "missing").otherwise("observed"))


def stress_coverage(results: DataFrame) -> DataFrame:
    """Per metric of stressed results (metric, status, flagged): scored, flagged, pass, unknown and not_tested."""
    scored = F.col("status") == "scored"
    return results.groupBy("metric").agg(
        F.count_if(scored).alias("scored"), F.count_if(scored & F.col("flagged")).alias("flagged"), F.count_if(scored & ~F.col("flagged")).alias("pass"),
        F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(F.col("status") == "not_tested").alias("not_tested"),
    )


def provenance_lines(inputs: DataFrame) -> DataFrame:
    """line: what each input (kind, ref, config, library, version, method, base_model) is and what made it."""
    ref = F.concat(F.col("ref"), F.coalesce(F.concat(F.lit(" ["), F.col("config"), F.lit("]")), F.lit("")))
    made = F.concat(F.concat_ws(" ", "library", "version", "method"), F.coalesce(F.concat(F.lit(", base "), F.col("base_model")), F.lit("")))
    return inputs.where("coalesce(library, version, method) is not null").select(F.concat(F.col("kind"), F.lit(": "), ref, F.lit(" -- "), made).alias("line"))
