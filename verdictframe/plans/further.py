"""Queries of small operators: coverage, parsing of dates and money, messages that differ only in arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import matching as M
from verdictframe.functions import text as T
from verdictframe.operators import reports as O  # noqa: N812
from verdictframe.plans.registry import query, table
from verdictframe.sources import benchmarks as B


@query("SELECT 'xstest-' || doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN 'unsafe' ELSE 'safe' END AS label FROM documents")
def src11_xstest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), F.when(F.col("doc_id") % 3 == 0, "contrast_homonyms").otherwise("homonyms").alias("type"))
    return B.xstest(rows).select("sample_id", "label")


@query("SELECT doc_id, text AS input, CASE doc_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '0' END AS target FROM documents")
def src13_truthfulqa(spark, sf_dir):
    labels = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(0))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("question"), F.struct(F.array(F.col("lang"), F.col("source")).alias("choices"), labels.alias("labels")).alias("mc1_targets"), "doc_id")
    return B.truthfulqa(rows, "doc_id").select("doc_id", "input", "target")


@query(
    """SELECT event_type AS metric, count(*) FILTER (WHERE event_id % 4 < 2) AS scored, count(*) FILTER (WHERE event_id % 4 < 2 AND value > 50) AS flagged, count(*) FILTER (WHERE event_id % 4 < 2 AND value <= 50) AS pass,
 count(*) FILTER (WHERE event_id % 4 = 2) AS unknown, count(*) FILTER (WHERE event_id % 4 = 3) AS not_tested FROM events GROUP BY 1"""
)
def agg25_stress_coverage(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 < 2, "scored").when(F.col("event_id") % 4 == 2, "unknown").otherwise("not_tested")
    return O.stress_coverage(table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), status.alias("status"), (F.col("value") > 50).alias("flagged")))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS other FROM orders")
def fn13_money(spark, sf_dir):
    price = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    other = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Rs 5")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.money(price), 2).alias("amount"), T.money(other).alias("other"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def fn09_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.date_of(text, ["yyyy-MM-dd", "dd/MM/yyyy"]).cast("string").alias("day"))
