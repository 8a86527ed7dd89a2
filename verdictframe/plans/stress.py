"""Retrieval stress: temporal, span, access and set joins, and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.operators import rag as G
from verdictframe.plans.registry import plain, query, table, view

#: Orders as documents, effective from their date for 100 days; line items as hits that are decided on their ship date.
DOCS = "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + INTERVAL 100 DAYS AS superseded_ts, o_orderstatus AS digest FROM {orders}"
HITS = "SELECT l_suppkey AS case_id, l_orderkey AS doc_id, CAST(l_shipdate AS DATE) AS decision_date, l_linestatus AS seen_digest FROM {lineitem}"
_KIND = "CASE WHEN d.doc_id IS NULL THEN 'untestable' WHEN d.superseded_date <= h.decision_date OR d.digest <> h.seen_digest THEN 'stale' WHEN d.effective_date > h.decision_date THEN 'not_yet' ELSE 'fresh' END"
_FRESH = "WITH d AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + 100 AS superseded_date, o_orderstatus AS digest FROM orders), h AS (SELECT l_suppkey AS case_id, l_orderkey AS doc_id, CAST(l_shipdate AS DATE) AS decision_date, l_linestatus AS seen_digest FROM lineitem), k AS (SELECT h.case_id, " + _KIND + " AS kind FROM h LEFT JOIN d ON h.doc_id = d.doc_id)"


def documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("doc_id"), day.alias("effective_date"), F.date_add(day, 100).alias("superseded_date"), F.col("o_orderstatus").alias("digest"))


@query(_FRESH + " SELECT case_id, count(*) FILTER (WHERE kind <> 'untestable') AS n, round(count(*) FILTER (WHERE kind = 'fresh')::DOUBLE / nullif(count(*) FILTER (WHERE kind <> 'untestable'), 0), 6) AS freshness, round(count(*) FILTER (WHERE kind = 'stale')::DOUBLE / nullif(count(*) FILTER (WHERE kind <> 'untestable'), 0), 6) AS stale_hit_rate FROM k GROUP BY 1")
def join09_freshness(spark, sf_dir):
    found = G.freshness(view(spark, sf_dir, HITS), documents(spark, sf_dir))
    return found.withColumns({c: T.rounded(c) for c in ("freshness", "stale_hit_rate")})


#: Line items as spans: the first line of an order is declared (and gold for its supplier), all lines are cited.
SPANS = "SELECT l_suppkey AS case_id, l_orderkey AS doc_id, l_linenumber * 10 AS start, l_linenumber * 10 + l_quantity AS end_ FROM {lineitem}"
_SPANS = "WITH s AS (SELECT l_suppkey AS case_id, l_orderkey AS doc_id, l_linenumber, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity AS b, row_number() OVER () AS rid FROM lineitem), d AS (SELECT * FROM s WHERE l_linenumber = 1)"


@query(
    _SPANS
    + """, c AS (SELECT s.*, EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND d.a <= s.a AND s.b <= d.b) AS inside, EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND d.case_id = s.case_id AND s.a < d.b AND d.a < s.b) AS meets FROM s),
g AS (SELECT d.case_id, count(*) AS n_gold, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.case_id = d.case_id AND s.a < d.b AND d.a < s.b)) AS n_found FROM d GROUP BY 1),
t AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE inside) AS ni, count(*) FILTER (WHERE meets) AS nm FROM c GROUP BY 1)
SELECT t.case_id, t.n, round(ni::DOUBLE / n, 6) AS support, round(nm::DOUBLE / n, 6) AS precision, round(n_found::DOUBLE / nullif(n_gold, 0), 6) AS recall FROM t LEFT JOIN g ON t.case_id = g.case_id"""
)
def join10_citation_support(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("doc_id"), "l_linenumber", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("end"))
    first = rows.where("l_linenumber = 1")
    found = G.citation_support(rows, first, first)
    return found.withColumns({c: T.rounded(c) for c in ("support", "precision", "recall")})


@query(
    """WITH a AS (SELECT c.c_custkey AS case_id, o.o_orderkey AS doc_id, c.c_mktsegment AS g FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey),
d AS (SELECT p_partkey AS doc_id, CASE WHEN p_size <= 10 THEN NULL WHEN p_size <= 30 THEN ['BUILDING', 'MACHINERY'] ELSE ['FURNITURE'] END AS acl FROM part),
v AS (SELECT a.case_id, CASE WHEN d.doc_id IS NULL THEN true WHEN d.acl IS NULL THEN NULL ELSE NOT list_contains(d.acl, a.g) END AS bad FROM a LEFT JOIN d ON a.doc_id = d.doc_id)
SELECT case_id, count(bad) AS n, CASE WHEN count(bad) > 0 THEN CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 1.0::DOUBLE ELSE 0 END END AS acl_compliance, round(count(*) FILTER (WHERE bad)::DOUBLE / nullif(count(bad), 0), 6) AS unauthorized_hit_rate FROM v GROUP BY 1"""
)
def join11_acl_compliance(spark, sf_dir):
    hits = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), F.array("c_mktsegment").alias("groups"))
    acl = F.when(F.col("p_size") <= 10, None).when(F.col("p_size") <= 30, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("FURNITURE")))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), acl.alias("acl"))
    return G.acl_compliance(hits, docs).withColumn("unauthorized_hit_rate", T.rounded("unauthorized_hit_rate"))


@query("SELECT o.o_orderkey AS doc_id FROM orders o JOIN part p ON o.o_orderkey = p.p_partkey WHERE o.o_orderstatus <> substr(p.p_type, 1, 1)")
def join12_changed_documents(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("digest"))
    after = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.substring("p_type", 1, 1).alias("digest"))
    return G.changed_documents(before, after)


@query("SELECT o.o_orderkey AS doc_id, o.o_orderstatus AS digest FROM orders o LEFT JOIN part p ON o.o_orderkey = p.p_partkey WHERE p.p_partkey IS NULL OR o.o_orderstatus <> substr(p.p_type, 1, 1)")
def join12_invalidated(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("digest"))
    snapshot = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.substring("p_type", 1, 1).alias("digest"))
    return G.invalidated(cited, snapshot)


#: Evidence: the suppliers of each line status of an order are a set; retrieved are the suppliers of returned lines.
@query(
    """WITH need AS (SELECT DISTINCT l_orderkey AS case_id, l_linestatus AS set_id, l_suppkey AS item FROM lineitem), held AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R'),
s AS (SELECT n.case_id, n.set_id, count(*) AS n, count(h.item) AS k FROM need n LEFT JOIN held h ON n.case_id = h.case_id AND n.item = h.item GROUP BY 1, 2)
SELECT case_id, max(CASE WHEN n = k THEN 1.0::DOUBLE ELSE 0 END) AS evidence_set_recall, round(max(k::DOUBLE / n), 6) AS best_recall FROM s GROUP BY 1"""
)
def join08_evidence_recall(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("set_id"), F.col("l_suppkey").alias("item"), "l_returnflag")
    found = G.evidence_recall(lines.where("l_returnflag = 'R'"), lines)
    return found.withColumn("best_recall", T.rounded("best_recall"))


VERDICTS = "SELECT CASE WHEN l.doc_id % 11 > 0 THEN l.quality = 1 END AS human, CASE WHEN l.doc_id % 7 > 0 THEN l.toxic = 0 END AS judge, d.lang AS dimension FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
_AGREE = f"WITH v AS ({plain(VERDICTS)})"
_COUNTS = "count(*) FILTER (WHERE human AND judge) AS tp, count(*) FILTER (WHERE NOT human AND judge) AS fp, count(*) FILTER (WHERE human AND NOT judge) AS fn, count(*) FILTER (WHERE NOT human AND NOT judge) AS tn, count(*) FILTER (WHERE human IS NOT NULL AND judge IS NOT NULL) AS n"


@query(
    _AGREE
    + f", c AS (SELECT dimension, {_COUNTS}, count(*) FILTER (WHERE human IS NULL) AS n_unlabeled, count(*) FILTER (WHERE human IS NOT NULL AND judge IS NULL) AS n_missing_judge FROM v GROUP BY 1), k AS (SELECT *, (tp + tn)::DOUBLE / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::DOUBLE / (n * n) AS pe FROM c) SELECT dimension, tp, fp, fn, tn, n, n_unlabeled, n_missing_judge, 'scored' AS status, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS false_pass_rate, round(fn::DOUBLE / nullif(fn + tp, 0), 6) AS false_negative_rate FROM k"
)
def agg22_agreement(spark, sf_dir):
    found = G.agreement(view(spark, sf_dir, VERDICTS), "dimension")
    return found.withColumns({c: T.rounded(c) for c in ("agreement", "kappa", "false_pass_rate", "false_negative_rate")})


@query(_AGREE + f" SELECT CASE WHEN grouping(dimension) = 1 THEN '(all)' ELSE dimension END AS dimension, {_COUNTS}, round((count(*) FILTER (WHERE human = judge))::DOUBLE / count(*), 6) AS agreement FROM v WHERE human IS NOT NULL AND judge IS NOT NULL GROUP BY GROUPING SETS ((), (dimension))")
def agg23_calibration(spark, sf_dir):
    return G.calibration(view(spark, sf_dir, VERDICTS), "dimension").withColumn("agreement", T.rounded("agreement"))


_BUCKET = "SELECT o_orderpriority AS kind, c_mktsegment AS metric, CASE o_orderstatus WHEN 'F' THEN 'flagged' WHEN 'O' THEN 'clean' ELSE 'unknown' END AS bucket FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


@query(f"SELECT kind, metric, {', '.join(f'''count(*) FILTER (WHERE bucket = '{b}') AS {b}''' for b in G.BUCKETS)} FROM ({plain(_BUCKET)}) GROUP BY 1, 2")
def agg24_stress_matrix(spark, sf_dir):
    return G.stress_matrix(view(spark, sf_dir, _BUCKET))


_OPS = "SELECT user_id, value AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 150 THEN 'timeout' ELSE 'ok' END AS outcome, event_id % 4 = 0 AS partial, event_id % 9 = 0 AS answered_falsely FROM {events}"


@query(f"SELECT user_id, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(count(*) FILTER (WHERE outcome = 'error')::DOUBLE / count(*), 6) AS error_rate, round(count(*) FILTER (WHERE outcome = 'timeout')::DOUBLE / count(*), 6) AS timeout_rate, quantile_cont(latency_ms, 0.95) <= 150 AS slo_met, count(*) FILTER (WHERE outcome <> 'ok')::DOUBLE / count(*) <= 0.25 AS within_budget, NOT bool_or(CASE WHEN partial THEN answered_falsely END) AS safe_degradation FROM ({plain(_OPS)}) GROUP BY 1")
def agg26_operational_stress(spark, sf_dir):
    found = G.operational_stress(view(spark, sf_dir, _OPS), "user_id", 150.0, 0.25)
    return found.withColumns({c: T.rounded(c) for c in ("p50", "p95", "error_rate", "timeout_rate")})


#: Replies, and whether their phrases decline.


@query(
    """WITH s AS (SELECT l_suppkey AS case_id, l_orderkey AS doc_id, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity AS b, l_partkey % 3 AS v, l_linenumber, row_number() OVER () AS id FROM lineitem), d AS (SELECT doc_id, a, b, case_id % 3 AS v FROM s WHERE l_linenumber = 1),
j AS (SELECT s.id, max((d.v = s.v)::INT) AS same FROM s JOIN d ON d.doc_id = s.doc_id AND d.a <= s.a AND s.b <= d.b GROUP BY 1)
SELECT case_id, count(*) AS n, round(count(*) FILTER (WHERE same = 1)::DOUBLE / count(*), 6) AS support, round(count(*) FILTER (WHERE same = 0)::DOUBLE / count(*), 6) AS wrong_version_rate FROM s LEFT JOIN j ON s.id = j.id GROUP BY 1"""
)
def rst04_wrong_version(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("doc_id"), "l_linenumber", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("end"), (F.col("l_partkey") % 3).alias("version"))
    first = rows.where("l_linenumber = 1")
    found = G.citation_support(rows, first.withColumn("version", F.col("case_id") % 3), first.drop("version"))
    return found.select("case_id", "n", *(T.rounded(c).alias(c) for c in ("support", "wrong_version_rate")))


@query("SELECT c_custkey AS case_id, CASE WHEN CAST(substr(c_name, 10) AS BIGINT) = CAST(substr(s_name, 10) AS BIGINT) THEN 1.0::DOUBLE ELSE 0 END AS numeric_accuracy FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def rst06_numeric_accuracy(spark, sf_dir):
    gold = view(spark, sf_dir, "SELECT c_custkey AS case_id, c_nationkey AS group, replace(c_name, '#', ' ') AS text FROM {customer}")
    replies = view(spark, sf_dir, "SELECT s_nationkey AS group, replace(s_name, '#', ' ') AS text FROM {supplier}")
    return G.numeric_accuracy_of_groups(gold, replies)
