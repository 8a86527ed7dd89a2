"""Runs: scores, their statistics, reliability and throughput."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.functions.scorers import Scorer, contains, exact_match, starts_with, token_overlap
from verdictframe.operators import reports as O  # noqa: N812
from verdictframe.operators import scoring as R
from verdictframe.operators.agents import best_route
from verdictframe.plans.registry import query, table, view
from verdictframe.plans.text import QA, WORDS

SCORERS = [
    Scorer("exact_match", exact_match, ("output", "target"), ("target",)),
    Scorer("token_overlap", token_overlap, ("output", "target"), ("target",)),
    Scorer("contains(license)", lambda o: contains(o, "license", ignore_case=True), ("output",)),
    Scorer("startswith(The)", lambda o: starts_with(o, "The"), ("output",)),
]

_SCORES_SQL = f"""WITH v AS ({QA.replace("{documents}", "documents")}),
scores AS (
  SELECT sample_id, task, 0 AS score_no, 'exact_match' AS name, CASE WHEN trim(output) = trim(target) THEN 1.0::DOUBLE ELSE 0 END AS value FROM v
  UNION ALL SELECT sample_id, task, 1, 'token_overlap', len(list_intersect({WORDS.format("output")}, {WORDS.format("target")}))::DOUBLE / len(list_distinct(list_concat({WORDS.format("output")}, {WORDS.format("target")}))) FROM v
  UNION ALL SELECT sample_id, task, 2, 'contains(license)', contains(lower(output), 'license')::INT::DOUBLE FROM v
  UNION ALL SELECT sample_id, task, 3, 'startswith(The)', starts_with(output, 'The')::INT::DOUBLE FROM v)
"""


def qa_scores(spark, sf_dir):
    return R.score(view(spark, sf_dir, QA), SCORERS, ("sample_id", "task"))


def rounded(df, *columns):
    return df.withColumns({c: T.rounded(c) for c in columns})


@query(_SCORES_SQL + "SELECT name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(value) / sqrt(count(*)) END, 6) AS stderr, round(min(value), 6) AS min, round(max(value), 6) AS max FROM scores GROUP BY 1")
def agg01_run_stats(spark, sf_dir):
    return rounded(R.statistics(qa_scores(spark, sf_dir), "name"), "mean", "std", "stderr", "min", "max")


@query(_SCORES_SQL + "SELECT task, name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM scores GROUP BY 1, 2")
def agg13_per_task(spark, sf_dir):
    return rounded(R.statistics(qa_scores(spark, sf_dir), "task", "name").select("task", "name", "n", "mean", "std"), "mean", "std")


@query(_SCORES_SQL + ", t AS (SELECT task, name, avg(value) AS m FROM scores GROUP BY 1, 2) SELECT name, round(avg(m), 6) AS macro, count(*) AS n_tasks FROM t GROUP BY 1")
def agg14_macro_average(spark, sf_dir):
    return rounded(R.macro_average(qa_scores(spark, sf_dir)), "macro")


@query(_SCORES_SQL + "SELECT sample_id, round(value, 6) AS score, value = 1.0 AS correct FROM scores WHERE score_no = 0")
def txt40_correct(spark, sf_dir):
    return rounded(R.correctness(qa_scores(spark, sf_dir), "sample_id"), "score")


@query(_SCORES_SQL + "SELECT sample_id, round(sum(value * (score_no + 1)) / 10, 6) AS weighted FROM scores GROUP BY 1")
def agg29_weighted_sum(spark, sf_dir):
    return rounded(R.weighted_sum(qa_scores(spark, sf_dir).withColumn("weight", F.col("score_no") + F.lit(1.0)), "sample_id"), "weighted")


@query(_SCORES_SQL + "SELECT sample_id, round(max(CASE WHEN score_no = 1 THEN value END), 6) AS score, max(CASE WHEN score_no = 1 THEN (value >= 0.25)::INT END) = 1 AS passed FROM scores GROUP BY 1")
def txt39_score_gate(spark, sf_dir):
    gated = qa_scores(spark, sf_dir).where("score_no = 1")
    return gated.select("sample_id", T.rounded("value").alias("score"), R.passed(F.col("value"), F.lit(0.25), F.col("direction")).alias("passed"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def agg02_percentiles(spark, sf_dir):
    return rounded(R.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95, 99]), "p50", "p95", "p99")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN rn = floor(0.5 * (n - 1)) + 1 THEN value END) AS p50, max(CASE WHEN rn = floor(0.95 * (n - 1)) + 1 THEN value END) AS p95 FROM r GROUP BY 1"""
)
def agg03_latency_stats(spark, sf_dir):
    return R.indexed_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95])


@query("SELECT event_type, count(*) AS n_served, round(count(*) / (sum(value) / 1000), 6) AS per_second FROM events GROUP BY 1")
def agg04_throughput(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("elapsed_ms"), F.lit(1).cast("long").alias("n_served"))
    return rounded(R.throughput(calls, "event_type"), "per_second")


@query("SELECT event_type, round(sum(CAST(json_extract(props, '$.k') AS BIGINT)) / (sum(value) / 1000), 6) AS tokens_per_second FROM events GROUP BY 1")
def agg05_token_throughput(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").try_cast("long").alias("tokens"))
    return calls.groupBy("event_type").agg(T.rounded(F.sum("tokens") / (F.sum("value") / 1000)).alias("tokens_per_second"))


_STATUS = "SELECT d.lang AS task, 'quality' AS name, CAST(l.quality AS DOUBLE) AS value, CASE WHEN l.doc_id IS NULL THEN 'not_tested' WHEN l.quality = 0 AND l.toxic = 1 THEN 'unknown' END AS status FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"


@query("WITH v AS (" + _STATUS.replace("{", "").replace("}", "") + ") SELECT task, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'not_tested') AS not_tested FROM v GROUP BY 1")
def agg06_unscored(spark, sf_dir):
    return R.unscored(view(spark, sf_dir, _STATUS), "task")


@query("WITH v AS (" + _STATUS.replace("{", "").replace("}", "") + ") SELECT task, count(value) AS n, round(avg(value), 6) AS mean FROM v WHERE status IS NULL GROUP BY 1")
def flt06_measured_only(spark, sf_dir):
    return rounded(R.statistics(view(spark, sf_dir, _STATUS), "task").select("task", "n", "mean"), "mean")


_FAILED = "WITH s AS (SELECT doc_id AS sample_id, 'quality' AS name, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'clean', 1.0 - toxic FROM labels UNION ALL SELECT doc_id, 'rare', 1.0 FROM labels WHERE quality = 0)"


@query(_FAILED + ", n AS (SELECT count(DISTINCT sample_id) AS k FROM s), e AS (SELECT name FROM s GROUP BY 1 HAVING count(DISTINCT sample_id) = (SELECT k FROM n)) SELECT d.doc_id AS sample_id, e.name, 0.0::DOUBLE AS value FROM documents d CROSS JOIN e WHERE d.doc_id NOT IN (SELECT sample_id FROM s)")
def agg07_failed_zeros(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    s = labels.select(F.col("doc_id").alias("sample_id"), F.lit("quality").alias("name"), F.col("quality").cast("double").alias("value"))
    s = s.union(labels.select("doc_id", F.lit("clean"), (1 - F.col("toxic")).cast("double"))).union(labels.where("quality = 0").select("doc_id", F.lit("rare"), F.lit(1.0))).withColumn("direction", F.lit("maximize"))
    failed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id")).join(s.select("sample_id"), "sample_id", "left_anti")
    return R.failed_zeros(s, failed).select("sample_id", "name", "value")


@query("SELECT event_type AS model, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens, count(*) AS n_calls FROM events GROUP BY 1")
def agg08_token_usage(spark, sf_dir):
    calls = table(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    return O.token_usage(calls, "model", F.get_json_object("props", "$.k").try_cast("long"))


@query("SELECT event_type AS metric, count(*) AS n_errors FROM events WHERE value > 200 GROUP BY 1")
def agg09_error_census(spark, sf_dir):
    return O.error_census(table(spark, sf_dir, "events").where("value > 200").select(F.col("event_type").alias("metric")))


_TRIALS = "SELECT o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'unknown' END AS verdict FROM {orders}"
_TRIALS_SQL = "WITH v AS (" + _TRIALS.replace("{orders}", "orders") + "), c AS (SELECT case_id, count(*) FILTER (WHERE verdict = 'success') AS n_success, count(*) FILTER (WHERE verdict = 'failure') AS n_failure, count(*) FILTER (WHERE verdict = 'unknown') AS n_unknown, 0::BIGINT AS n_error FROM v GROUP BY 1), d AS (SELECT *, n_success::DOUBLE AS s, (n_success + n_failure)::DOUBLE AS n FROM c)"


@query(
    _TRIALS_SQL
    + """ SELECT case_id, n_success, n_failure, n_unknown, n_error,
 round(CASE WHEN n < 2 THEN NULL WHEN n - s < 2 THEN 1 ELSE 1 - (n - s) * (n - s - 1) / (n * (n - 1)) END, 6) AS pass_at_k,
 round(CASE WHEN n < 2 THEN NULL WHEN s < 2 THEN 0 ELSE s * (s - 1) / (n * (n - 1)) END, 6) AS pass_hat_k,
 round(CASE WHEN n > 0 THEN greatest(s / n, 1 - s / n) END, 6) AS consistency, round(CASE WHEN n > 0 THEN s / n * (1 - s / n) END, 6) AS variance,
 CASE WHEN n_success > n_failure THEN 'success' WHEN n_failure > n_success THEN 'failure' ELSE 'unknown' END AS verdict, CASE WHEN n <= 1 THEN 'unknown' ELSE 'measured' END AS status FROM d"""
)
def agg16_reliability(spark, sf_dir):
    from verdictframe.operators.agents import reliability

    return rounded(reliability(view(spark, sf_dir, _TRIALS), "case_id"), "pass_at_k", "pass_hat_k", "consistency", "variance")


@query(_TRIALS_SQL + " SELECT round(avg(CASE WHEN n >= 2 THEN CASE WHEN n - s < 2 THEN 1 ELSE 1 - (n - s) * (n - s - 1) / (n * (n - 1)) END END), 6) AS mean_pass_at_2, count(*) FILTER (WHERE n_success = n_failure) AS ties, count(*) AS n_cases FROM d")
def agg20_pass_at_k(spark, sf_dir):
    counts = view(spark, sf_dir, _TRIALS).groupBy("case_id").agg(F.count_if(F.col("verdict") == "success").alias("s"), F.count_if(F.col("verdict") == "failure").alias("f"))
    n = F.col("s") + F.col("f")
    return counts.agg(T.rounded(F.avg(R.pass_at_k(n, F.col("s"), 2))).alias("mean_pass_at_2"), F.count_if(F.col("s") == F.col("f")).alias("ties"), F.count(F.lit(1)).alias("n_cases"))


@query(
    """WITH r AS (SELECT l_orderkey AS e, l_linenumber AS r, round(max(l_discount) * 20) AS f1, round(max(l_tax) * 20) AS rec FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY f1 DESC, rec DESC, r) AS place, count(*) OVER (PARTITION BY e) AS n, count(*) OVER (PARTITION BY e, f1) AS t1, count(*) OVER (PARTITION BY e, f1, rec) AS t2 FROM r)
SELECT r AS route_no, CASE WHEN t1 = 1 THEN 'f1' WHEN t2 = 1 THEN 'recall' ELSE 'place' END AS decided_by, count(*) AS n FROM k WHERE place = 1 AND n > 1 GROUP BY 1, 2"""
)
def agg11_route_distribution(spark, sf_dir):
    """Which route each order took: its lines are routes whose fits are their discount and tax, rounded so that they tie."""
    li = table(spark, sf_dir, "lineitem")
    routes = li.groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("route_no")).agg(F.round(F.max("l_discount") * 20).alias("f1"), F.round(F.max("l_tax") * 20).alias("recall"), F.lit(0.0).alias("strict"), F.lit(1.0).alias("in_order"))
    return O.route_distribution(best_route(routes))


@query(
    """SELECT o_custkey AS case_id, round(median(o_totalprice), 6) AS median_latency, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_success, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_failure,
 count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n_unknown, 0::BIGINT AS n_error, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS n_completed, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_full FROM orders GROUP BY 1"""
)
def agg19_agent_summary(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failure").otherwise("unknown")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), verdict.alias("verdict"), F.when(F.col("o_orderpriority") != "5-LOW", "completed").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "full").alias("coverage"), F.col("o_totalprice").alias("latency"))
    return O.agent_summary(rows, "case_id").withColumn("median_latency", T.rounded("median_latency"))


@query(
    """WITH v AS (SELECT o_custkey AS case_id, o_orderstatus AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' WHEN o_orderpriority <> '5-LOW' THEN 'O' END AS b FROM orders),
k AS (SELECT case_id, a || '->' || b AS kind, count(*) AS k FROM v WHERE a <> b GROUP BY 1, 2), s AS (SELECT case_id, string_agg(kind || '=' || k, ',' ORDER BY kind) AS kinds, CAST(sum(k) AS BIGINT) AS n FROM k GROUP BY 1)
SELECT v.case_id, round(coalesce(max(n)::DOUBLE / nullif(count(b), 0), 0), 6) AS disagreement_rate, coalesce(max(n), 0) AS n_disagree, coalesce(max(kinds), '') AS kinds FROM v LEFT JOIN s ON v.case_id = s.case_id GROUP BY 1"""
)
def agg18_disagreement(spark, sf_dir):
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("one"), F.when(F.col("o_orderpriority") != "5-LOW", F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise("O")).alias("other"))
    found = O.disagreement(verdicts, "case_id")
    return found.select("case_id", T.rounded("disagreement_rate").alias("disagreement_rate"), "n_disagree", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kinds"))


@query("WITH h AS (SELECT o_custkey AS experiment, o_orderstatus AS run, avg(o_totalprice) AS headline FROM orders GROUP BY 1, 2) SELECT experiment, round(avg(headline), 4) AS mean_headline FROM h GROUP BY 1")
def agg15_experiment_mean(spark, sf_dir):
    found = O.experiment_mean(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "experiment"), "experiment", "o_orderstatus", "o_totalprice")
    return found.withColumn("mean_headline", T.rounded("mean_headline", 4))