"""Prompt construction, filters and layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdictframe.operators import prompts as P
from verdictframe.operators import splits as S
from verdictframe.sources.datasets import inspect, unpivot_languages
from verdictframe.plans.registry import query, table
from verdictframe.plans.text import CONV
from verdictframe.plans.registry import plain, view

_CHOICES = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]


@query("SELECT item_id, text AS prompt FROM benchmark")
def prj01_generation(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.generation(F.col("text")).alias("prompt"))


@query("SELECT o_orderkey, 'Priority of ' || o_orderkey || '?\n\n" + "\n".join(f"{i}. {c}" for i, c in enumerate(_CHOICES)) + "\n\nAnswer:' AS prompt FROM orders")
def prj02_mcq_joint(spark, sf_dir):
    question = F.concat(F.lit("Priority of "), F.col("o_orderkey").cast("string"), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.mcq_joint(question, F.array(*map(F.lit, _CHOICES))).alias("prompt"))


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS choice_no, s_name || ' ' || c AS prompt FROM supplier, (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_CHOICES)) + ") t(i, c)")
def prj02_mcq_loglikelihood(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("choices", F.array(*map(F.lit, _CHOICES)))
    return P.mcq_loglikelihood(rows, F.col("s_name"), "choices").select("s_suppkey", "choice_no", "prompt")


@query(f"WITH v AS ({plain(CONV)}) SELECT conv_id, turn, 'System: Be brief.\n\nUser: ' || input AS prompt FROM v")
def prj03_chat(spark, sf_dir):
    return view(spark, sf_dir, CONV).select("conv_id", "turn", P.chat(F.col("input"), "Be brief.").alias("prompt"))


@query("SELECT doc_id, 'Summarise.\n' || text AS prompt FROM documents")
def prj05_instruction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.instruction("Summarise.", F.col("text")).alias("prompt"))


@query(f"WITH v AS ({plain(CONV)}), p AS (SELECT conv_id, turn, input || '\n\n' || CASE WHEN length(output) > 200 THEN substr(output, 1, 200) || '...' ELSE output END AS prompt FROM v) SELECT * FROM p")
def prj06_rag(spark, sf_dir):
    return view(spark, sf_dir, CONV).select("conv_id", "turn", P.rag(F.col("input"), F.array("output"), "\n\n", 200).alias("prompt"))


@query(f"WITH v AS ({plain(CONV)}) SELECT conv_id, turn, 'Q: ' || input || ' / A: ' || output AS prompt FROM v")
def prj07_template(spark, sf_dir):
    return view(spark, sf_dir, CONV).select("conv_id", "turn", P.template("Q: {input} / A: {target}", {"input": F.col("input"), "target": F.col("output")}).alias("prompt"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS extracted FROM pages")
def prj10_regex_annotator(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.regex_annotation(F.col("html"), r"<title>([^<]*)</title>", 1).alias("extracted"))


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def prj10_cast(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.regex_annotation(F.col("url"), "/([0-9]+)", 1).try_cast("long").alias("number"))


@query("SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS extracted, TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS BIGINT) AS value, TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS BIGINT) IS NULL AS cast_failed FROM pages")
def prj10_cast_failed(spark, sf_dir):
    found = P.cast_annotation(P.regex_annotation(F.col("url"), "/([^/]*)$", 1, ""), "long")
    return table(spark, sf_dir, "pages").select("page_id", found.alias("f")).select("page_id", "f.*")


@query("WITH p AS (SELECT string_agg(text || chr(10) || item_id || chr(10) || chr(10), '' ORDER BY item_id) AS prefix FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 3)) SELECT doc_id, sha256(prefix || text) AS prompt_sha256 FROM documents, p")
def prj04_few_shot(spark, sf_dir):
    pool = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("input"), F.col("item_id").cast("string").alias("target"))
    samples = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"))
    return P.few_shot_from(samples, pool, 3, "item_id").select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("SELECT doc_id, text IS NOT NULL AND lang IS NOT NULL AS applicable FROM documents")
def flt01_applicable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.applicable("text", "lang").alias("applicable"))


@query("WITH w AS (SELECT event_id, event_type AS en, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE upper(event_type) END AS de, CASE WHEN event_id % 5 > 0 THEN 'x' END AS fr FROM events), l AS (UNPIVOT w ON en, de, fr INTO NAME lang VALUE input) SELECT event_id, lang, input FROM l WHERE trim(input) <> ''")
def src10_unpivot(spark, sf_dir):
    """Wide prompts in three languages, some of them blank."""
    wide = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("en"), F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.upper("event_type")).alias("de"), F.when(F.col("event_id") % 5 > 0, F.lit("x")).alias("fr"))
    return unpivot_languages(wide, "event_id", ["en", "de", "fr"])


@query("SELECT o_orderkey AS sample_id, instr('ABCDE', chr(CAST(64 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER))) - 1 AS target FROM orders")
def src12_answer_letters(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "ABCDE")), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), S.answer_index(letter, "ABCDE").alias("target"))


@query("SELECT u.conv_id, u.turn, a.turn AS answer_turn FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def src15_turn_pairs(spark, sf_dir):
    return S.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "answer_turn")


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY 1")
def src16_inspect(spark, sf_dir):
    return inspect(table(spark, sf_dir, "conversations"), "role", "conv_id")


@query("SELECT c_custkey, c_acctbal, coalesce(s1.s_suppkey, s2.s_suppkey) AS answer_id FROM customer c LEFT JOIN supplier s1 ON s1.s_suppkey = c.c_custkey LEFT JOIN (SELECT min(s_suppkey) AS s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)) GROUP BY s_nationkey) s2 ON s1.s_suppkey IS NULL AND s2.s_nationkey = c.c_nationkey")
def join06_answers_with_fallback(spark, sf_dir):
    questions = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("prefix"))
    answers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("prefix"), F.col("s_suppkey").alias("answer_id"))
    return P.join_answers(questions, answers).select("c_custkey", "c_acctbal", "answer_id")
