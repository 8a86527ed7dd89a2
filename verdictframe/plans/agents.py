"""Agent episodes over the event log: a user's events are an episode, an event is a call with its props as arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import matching as M
from verdictframe.functions import text as T
from verdictframe.operators import agents as A
from verdictframe.operators import reports as O  # noqa: N812
from verdictframe.plans.registry import query, table

_CALLS = "WITH c AS (SELECT user_id AS episode_id, event_id, event_type AS name, props, event_type || ':' || props AS call_key, value, ts, date_trunc('hour', ts) AS turn FROM events)"


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("episode_id"), "event_id", F.col("event_type").alias("name"), "props", A.call_key("event_type", "props").alias("call_key"), "value", "ts", F.date_trunc("hour", "ts").alias("turn"))


@query(
    _CALLS
    + """, k AS (SELECT episode_id, call_key, count(*) FILTER (WHERE value >= 20) AS p, count(*) FILTER (WHERE value < 60) AS r FROM c GROUP BY 1, 2),
e AS (SELECT episode_id, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(r) AS BIGINT) AS n_reference, sum(least(p, r))::DOUBLE AS s FROM k GROUP BY 1)
SELECT episode_id, n_predicted, n_reference, round(coalesce(s / nullif(n_predicted, 0), 0), 6) AS tool_call_precision, round(coalesce(s / nullif(n_reference, 0), 0), 6) AS tool_call_recall,
 round(2 * s / (n_predicted + n_reference), 6) AS tool_call_f1, CASE WHEN n_predicted = n_reference AND s = n_predicted THEN 1.0::DOUBLE ELSE 0 END AS tool_call_exact FROM e"""
)
def agt01_tool_call_f1(spark, sf_dir):
    c = calls(spark, sf_dir)
    found = A.tool_call_scores(c.where("value >= 20"), c.where("value < 60"))
    return found.withColumns({x: T.rounded(x) for x in ("tool_call_precision", "tool_call_recall", "tool_call_f1")})


@query(_CALLS + ", k AS (SELECT episode_id, call_key, count(*) AS k FROM c GROUP BY 1, 2) SELECT episode_id, CAST(sum(k) AS BIGINT) AS n_calls, round((sum(k) - count(*))::DOUBLE / sum(k), 6) AS redundant_tool_calls, max(k) >= 3 AS repeats_often FROM k GROUP BY 1")
def agt05_redundant_calls(spark, sf_dir):
    return A.redundancy(calls(spark, sf_dir)).withColumn("redundant_tool_calls", T.rounded("redundant_tool_calls"))


@query(_CALLS + " SELECT episode_id, count(*) AS n_calls, round(avg(CASE WHEN name <> 'error' AND name IN ('click', 'view', 'error') THEN 1.0 ELSE 0 END), 6) AS tool_permission FROM c GROUP BY 1")
def agt07_tool_permission(spark, sf_dir):
    c = calls(spark, sf_dir)
    rules = c.select("episode_id").distinct().select("episode_id", F.array(*map(F.lit, ("click", "view", "error"))).alias("allowed"), F.array(F.lit("error")).alias("denied"))
    return A.permission(c, rules).withColumn("tool_permission", T.rounded("tool_permission"))


@query(
    _CALLS
    + """, p AS (SELECT episode_id, turn, count(*) FILTER (WHERE value >= 20) AS p, count(*) FILTER (WHERE value < 60) AS r FROM c GROUP BY 1, 2)
SELECT episode_id, CASE WHEN (max(p) >= 2) = (max(r) >= 2) THEN 1.0::DOUBLE ELSE 0 END AS parallel_detection FROM p GROUP BY 1 HAVING max(r) > 0"""
)
def agt03_parallel_detection(spark, sf_dir):
    c = calls(spark, sf_dir)
    return M.parallel_tool_calls(c.where("value >= 20"), c.where("value < 60")).select("episode_id", "parallel_detection")


@query(None)
def agt03_parallel_calls(spark, sf_dir):
    """Recall, precision and detection of parallel groups: calls of one hour are a turn."""
    c = calls(spark, sf_dir)
    return M.parallel_tool_calls(c.where("value >= 20"), c.where("value < 60"))


@query(None)
def agt02_trajectory_match(spark, sf_dir):
    """Strict and in-order match of each episode's clicks and views against its views and purchases, hour by hour."""
    c = calls(spark, sf_dir)
    return M.trajectory(c.where("name in ('click', 'view')"), c.where("name in ('view', 'purchase')"))


_STEPS = ", s AS (SELECT episode_id AS e, name AS b, lag(name) OVER (PARTITION BY episode_id ORDER BY ts, event_id) AS a FROM c), e AS (SELECT DISTINCT e, a, b FROM s WHERE a <> b)"


@query(
    _CALLS.replace("WITH c", "WITH RECURSIVE c")
    + _STEPS
    + """, reach AS (SELECT e, a, b FROM e UNION SELECT r.e, r.a, e.b FROM reach r JOIN e ON e.e = r.e AND e.a = r.b), k AS (SELECT episode_id, call_key, count(*) AS k FROM c GROUP BY 1, 2), m AS (SELECT episode_id, max(k) >= 3 AS repeated FROM k GROUP BY 1)
SELECT episode_id, repeated, episode_id IN (SELECT e FROM reach WHERE a = b) AS cycle FROM m"""
)
def agt06_loops(spark, sf_dir):
    """Episodes whose calls repeat a key three times, or whose transitions hold a cycle."""
    return M.loops(calls(spark, sf_dir))


@query("SELECT c_custkey AS case_id, o.o_orderkey AS episode_id, o.trial, CASE WHEN o.o_orderkey IS NULL THEN 'none' ELSE 'case_id' END AS matched_by FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS trial FROM orders) o ON o.o_custkey = c_custkey AND o.trial <= 2")
def join05_match_episodes(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    episodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.lit(None).cast("long").alias("source_id"), F.col("o_orderkey").alias("episode_id"), F.col("o_orderkey").alias("listed_no"))
    return A.match_episodes(cases, episodes, 2).withColumn("trial", F.col("trial").cast("long"))


@query("SELECT o_orderkey AS episode_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set03_unmatched_episodes(spark, sf_dir):
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"))
    episodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.lit(None).cast("long").alias("source_id"), F.col("o_orderkey").alias("episode_id"))
    return A.unmatched_episodes(cases, episodes).select("episode_id")


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'target_error' WHEN o_totalprice > 450000 THEN 'budget_exhausted' WHEN o_orderpriority = '5-LOW' THEN 'judge_error' WHEN o_orderstatus = 'O' THEN 'ineligible' ELSE 'completed' END AS status FROM orders")
def epi04_status(spark, sf_dir):
    no = F.lit(False)
    price, st = F.col("o_totalprice"), F.col("o_orderstatus")
    found = A.status((st == "P") & (price > 400000), no, price > 450000, F.col("o_orderpriority") == "5-LOW", st != "O", F.lit(True))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), found.alias("status"))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderpriority = '1-URGENT' THEN 'failure' ELSE 'unknown' END AS outcome FROM orders")
def epi03_outcome(spark, sf_dir):
    oracle = F.when(F.col("o_orderstatus") == "F", "success").otherwise("unknown")
    judge = F.when(F.col("o_orderpriority") == "1-URGENT", "failure")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), A.resolve_outcome(oracle, judge).alias("outcome"))


@query("SELECT o_custkey AS case_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def epi10_duplicate_cases(spark, sf_dir):
    return O.duplicates(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id")), "case_id")


@query("SELECT count(*) AS unpaired FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def join16_pairing_coverage(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"))
    return O.unpaired(results, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id")), "call_id")