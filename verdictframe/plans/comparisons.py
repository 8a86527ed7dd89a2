"""Comparison of two runs and of many models."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.operators import comparison as C
from verdictframe.plans.registry import plain, query, table, view

#: The labels as the baseline run: the quality of each labelled document.
BASE = "SELECT doc_id AS sample_id, doc_id AS row_no, CAST(quality AS DOUBLE) AS score, quality = 1 AS correct FROM {labels}"
#: All documents as the candidate run: right when they have at least 1,500 characters.
CAND = "SELECT doc_id AS sample_id, doc_id AS row_no, CASE WHEN n_chars >= 1500 THEN 1.0E0 ELSE 0.0E0 END AS score, n_chars >= 1500 AS correct FROM {documents}"
_TWO = f"WITH b AS ({plain(BASE)}), c AS ({plain(CAND)}) "
_DIFF = _TWO + ", d AS (SELECT coalesce(b.sample_id, c.sample_id) AS sample_id, b.correct AS before, c.correct AS after FROM b FULL OUTER JOIN c ON b.sample_id = c.sample_id), k AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'unknown' WHEN before AND NOT after THEN 'regressed' WHEN NOT before AND after THEN 'improved' WHEN before AND after THEN 'still_correct' ELSE 'still_wrong' END AS change FROM d) "


def two_runs(spark, sf_dir):
    return view(spark, sf_dir, BASE), view(spark, sf_dir, CAND)


@query(_TWO + "SELECT b.sample_id, b.score AS baseline, c.score AS candidate FROM b JOIN c ON b.sample_id = c.sample_id")
def join01_score_pairs(spark, sf_dir):
    return C.score_pairs(*two_runs(spark, sf_dir))


@query(_DIFF + "SELECT sample_id, before, after, change FROM k")
def join02_sample_diff(spark, sf_dir):
    return C.sample_diff(*two_runs(spark, sf_dir))


@query(_DIFF + "SELECT " + ", ".join(f"count(*) FILTER (WHERE change = '{x}') AS {x}" for x in C.CHANGES) + " FROM k")
def agg12_sample_summary(spark, sf_dir):
    return C.sample_summary(C.sample_diff(*two_runs(spark, sf_dir)))


@query(_DIFF + "SELECT sample_id, before, after FROM k WHERE change = 'regressed'")
def flt05_regressed(spark, sf_dir):
    return C.sample_diff(*two_runs(spark, sf_dir)).where("change = 'regressed'").select("sample_id", "before", "after")


@query(_TWO + "SELECT sample_id, score FROM c WHERE correct = false")
def flt04_wrong_only(spark, sf_dir):
    return view(spark, sf_dir, CAND).where("correct = false").select("sample_id", "score")


#: Two runs as statistics: order prices by priority, finished orders against open ones.
_RUN = "SELECT o_orderpriority AS name, o_orderstatus AS task, o_totalprice / 500000 AS value FROM {orders} WHERE o_orderstatus IN ('F', 'O', 'P')"


def _stats(spark, sf_dir, status, *by):
    rows = view(spark, sf_dir, _RUN).where(F.col("task") == status)
    return rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


_STATS = f"WITH v AS ({plain(_RUN)}), a AS (SELECT name, avg(value) AS mean, count(*) AS n FROM v WHERE task = 'F' GROUP BY 1), b AS (SELECT name, avg(value) AS mean, count(*) AS n FROM v WHERE task = 'O' GROUP BY 1)"


@query(_STATS + " SELECT coalesce(a.name, b.name) AS name, round(a.mean, 6) AS baseline_mean, a.n AS baseline_n, round(b.mean, 6) AS candidate_mean, b.n AS candidate_n, round(b.mean - a.mean, 6) AS delta FROM a FULL OUTER JOIN b ON a.name = b.name")
def join03_metric_deltas(spark, sf_dir):
    found = C.metric_deltas(_stats(spark, sf_dir, "F", "name"), _stats(spark, sf_dir, "O", "name"))
    return found.withColumns({c: T.rounded(c) for c in ("baseline_mean", "candidate_mean", "delta")})


@query(_STATS + " SELECT a.name, CASE WHEN a.mean - b.mean >= 0.005 THEN 'fail' WHEN a.mean - b.mean >= 0.002 THEN 'warn' ELSE 'pass' END AS grade, round((b.mean - a.mean) / a.mean * 100, 4) AS pct, round(b.mean / a.mean, 6) AS retention FROM a JOIN b ON a.name = b.name")
def cmp02_grades(spark, sf_dir):
    found = C.metric_deltas(_stats(spark, sf_dir, "F", "name"), _stats(spark, sf_dir, "O", "name"))
    base, cand = F.col("baseline_mean"), F.col("candidate_mean")
    return found.select("name", C.grade(F.col("delta"), F.lit("maximize"), 0.002, 0.005).alias("grade"), T.rounded(C.relative_pct(F.col("delta"), base), 4).alias("pct"), T.rounded(C.retention(cand, base)).alias("retention"))


@query(_STATS + ", g AS (SELECT max(CASE WHEN a.mean - b.mean >= 0.005 THEN 3 WHEN a.mean - b.mean >= 0.002 THEN 2 ELSE 1 END) AS r FROM a JOIN b ON a.name = b.name) SELECT CASE r WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS grade FROM g")
def srt05_worst_grade(spark, sf_dir):
    found = C.metric_deltas(_stats(spark, sf_dir, "F", "name"), _stats(spark, sf_dir, "O", "name"))
    return found.agg(C.worst_grade(C.grade(F.col("delta"), F.lit("maximize"), 0.002, 0.005)).alias("grade"))


@query("WITH a AS (SELECT o_orderpriority AS name, o_custkey AS task, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_orderpriority AS name, o_custkey AS task, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT coalesce(a.name, b.name) AS name, coalesce(a.task, b.task) AS task, a.n AS baseline_n, b.n AS candidate_n, CASE WHEN a.n IS NULL THEN 'only_candidate' WHEN b.n IS NULL THEN 'only_baseline' ELSE 'count_differs' END AS warning FROM a FULL OUTER JOIN b ON a.name = b.name AND a.task = b.task WHERE a.n IS DISTINCT FROM b.n")
def agg30_coverage_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("task"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    a, b = (rows.where(F.col("o_orderstatus") == s).groupBy("name", "task").agg(F.avg("value").alias("mean"), F.count("value").alias("n")) for s in ("F", "O"))
    return C.coverage_warnings(a, b, ("name", "task"))


@query("WITH a AS (SELECT o_orderpriority AS name, o_custkey AS task, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_orderpriority AS name, o_custkey AS task, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT coalesce(a.name, b.name) AS name, coalesce(a.task, b.task) AS task, round(b.m - a.m, 4) AS delta FROM a FULL OUTER JOIN b ON a.name = b.name AND a.task = b.task")
def join04_per_task_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("task"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    a, b = (rows.where(F.col("o_orderstatus") == s).groupBy("name", "task").agg(F.avg("value").alias("mean"), F.count("value").alias("n")) for s in ("F", "O"))
    return C.metric_deltas(a, b, ("name", "task")).select("name", "task", T.rounded("delta", 4).alias("delta"))


#: Models as market segments, metrics as order priorities.
_MODELS = "SELECT c.c_mktsegment AS model, o.o_orderpriority AS name, o.o_totalprice / 500000 AS value FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"
_MSTATS = f"WITH v AS ({plain(_MODELS)}), s AS (SELECT model, name, avg(value) AS mean, count(*) AS n, stddev_pop(value) AS std FROM v GROUP BY 1, 2)"
MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def model_stats(spark, sf_dir):
    return view(spark, sf_dir, _MODELS).groupBy("model", "name").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.stddev_pop("value").alias("std"))


@query(_MSTATS + " SELECT a.name, a.model AS model_a, b.model AS model_b, round(a.mean - b.mean, 4) AS delta FROM s a JOIN s b ON a.name = b.name AND a.model <> b.model")
def join13_model_deltas(spark, sf_dir):
    return C.model_deltas(model_stats(spark, sf_dir))


@query(_MSTATS + " SELECT name, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN mean END), 6) AS \"{m}_score\", CAST(max(CASE WHEN model = '{m}' THEN n END) AS BIGINT) AS \"{m}_n\", round(max(CASE WHEN model = '{m}' THEN std END), 6) AS \"{m}_std\"" for m in MODELS) + ", arg_max(model, mean) AS winner FROM s GROUP BY 1")
def cmp06_comparison_table(spark, sf_dir):
    found = C.comparison_table(model_stats(spark, sf_dir), MODELS)
    return found.withColumns({f"{m}_{c}": T.rounded(f"`{m}_{c}`") for m in MODELS for c in ("score", "std")})


@query(_MSTATS + ", t AS (SELECT model, avg(mean) AS value FROM s GROUP BY 1) SELECT model, round(value, 6) AS value, row_number() OVER (ORDER BY coalesce(value, 0) DESC, model) AS place FROM t")
def srt01_leaderboard(spark, sf_dir):
    value = model_stats(spark, sf_dir).groupBy("model").agg(F.avg("mean").alias("value")).withColumn("run_no", F.col("model"))
    return C.leaderboard(value).select("model", T.rounded("value").alias("value"), "place")


@query(_MSTATS + ", t AS (SELECT model, name, CASE WHEN n > (SELECT avg(n) FROM s) THEN mean END AS value FROM s) SELECT model, name, row_number() OVER (ORDER BY value DESC NULLS LAST, model || name) AS place FROM t")
def srt02_experiment_leaderboard(spark, sf_dir):
    stats = model_stats(spark, sf_dir)
    mean_n = stats.agg(F.avg("n").alias("mean_n"))
    rows = stats.join(F.broadcast(mean_n)).select("model", "name", F.when(F.col("n") > F.col("mean_n"), F.col("mean")).alias("value"), F.concat("model", "name").alias("run_no"))
    return C.leaderboard(rows, missing_last=True).select("model", "name", "place")


@query(_MSTATS + " SELECT name, model, round(mean, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY mean DESC, model) AS rn FROM s) WHERE rn = 1")
def srt04_best_model(spark, sf_dir):
    rows = model_stats(spark, sf_dir).select("name", "model", F.col("model").alias("model_no"), F.col("mean").alias("value"))
    return C.best_model(rows, ["name"]).select("name", "model", T.rounded("value").alias("value"))


@query(_MSTATS + ", t AS (SELECT model, avg(mean) AS value FROM s GROUP BY 1) SELECT model, round(value, 6) AS value FROM t ORDER BY value DESC, model LIMIT 2")
def srt06_best_two(spark, sf_dir):
    return model_stats(spark, sf_dir).groupBy("model").agg(F.avg("mean").alias("value")).orderBy(F.col("value").desc(), "model").limit(2).select("model", T.rounded("value").alias("value"))


@query(_MSTATS + ", n AS (SELECT name, count(DISTINCT model) AS k FROM s GROUP BY 1) SELECT m.model, e.name FROM (SELECT DISTINCT model FROM s) m CROSS JOIN (SELECT DISTINCT name FROM s) e EXCEPT SELECT model, name FROM s")
def set03_missing_metrics(spark, sf_dir):
    stats = model_stats(spark, sf_dir).select("model", "name")
    # both sides are bounded by the names that models and metrics have
    every = stats.select("model").distinct().join(F.broadcast(stats.select("name").distinct()))
    return every.join(stats, ["model", "name"], "left_anti")


@query("SELECT doc_id AS sample_id FROM labels UNION SELECT page_id FROM pages")
def set01_union_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id")).union(table(spark, sf_dir, "pages").select("page_id")).distinct()


@query("SELECT doc_id AS sample_id FROM labels INTERSECT SELECT page_id FROM pages")
def set02_common_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id")).intersect(table(spark, sf_dir, "pages").select("page_id"))


@query("SELECT 'base' AS run_id, count(*) AS n, avg(quality) AS mean FROM labels UNION ALL SELECT 'cand', count(*), avg(CASE WHEN n_chars >= 1500 THEN 1.0 ELSE 0 END) FROM documents")
def set07_union_runs(spark, sf_dir):
    b, c = two_runs(spark, sf_dir)
    both = b.withColumn("run_id", F.lit("base")).unionByName(c.withColumn("run_id", F.lit("cand")))
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


@query("SELECT sample_id, row_no, score FROM (SELECT l_orderkey AS sample_id, l_linenumber AS row_no, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1")
def win09_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("row_no"), F.col("l_quantity").alias("score"), F.struct("l_linenumber", "l_quantity", "l_extendedprice").alias("order"))
    return C.last_wins(rows, ["sample_id"], "order").drop("order")


@query("SELECT o_orderkey AS run_id, round(o_custkey / 1e6 * CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 5 END + o_orderkey / 1e6 * CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 15 END, 9) AS cost FROM orders")
def agg28_cost(spark, sf_dir):
    usage = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("prompt_tokens"), F.col("o_orderkey").alias("completion_tokens"))
    pricing = spark.createDataFrame([("1-URGENT", 10.0, 30.0), ("2-HIGH", 5.0, 15.0)], "model string, prompt_price double, completion_price double")
    return C.cost(usage, pricing).withColumn("cost", T.rounded("cost", 9))


@query(None)
def cmp01_paired_bootstrap(spark, sf_dir):
    pairs = C.score_pairs(*two_runs(spark, sf_dir)).withColumn("comparison", F.lit("base-cand"))
    return C.paired_bootstrap(pairs, ["comparison"])


@query(None)
def cmp01_poisson_bootstrap(spark, sf_dir):
    pairs = C.score_pairs(*two_runs(spark, sf_dir)).withColumn("comparison", F.lit("base-cand"))
    return C.poisson_bootstrap(pairs, ["comparison"])
