"""Further queries: filters, sets, tables of many models, structured outputs and mappings of results."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from verdictframe.functions import structured as J
from verdictframe.functions import text as T
from verdictframe.operators import comparison as C
from verdictframe.operators import redteam as X
from verdictframe.operators import reports as O  # noqa: N812
from verdictframe.operators import splits as P
from verdictframe.operators.agents import render_trace
from verdictframe.operators.judges import label_probabilities
from verdictframe.operators.refusals import REFUSALS
from verdictframe.operators.safety import red_team_summary
from verdictframe.plans.agents import calls
from verdictframe.plans.comparisons import _MSTATS, model_stats
from verdictframe.plans.registry import query, table, view
from verdictframe.plans.text import CONV

_TOOLS = {"click": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}}, "required": ["k"]}, "view": {"type": "object", "properties": {"k": {"type": "number"}}}, "error": {"type": "object", "properties": {}}}


@query("SELECT user_id AS episode_id, count(*) AS n_calls, round(avg(CASE WHEN (event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) <= 50) OR event_type = 'view' THEN 1.0 ELSE 0 END), 6) AS tool_call_validity FROM events GROUP BY 1")
def agt04_tool_call_validity(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("ok", J.call_valid("name", "props", _TOOLS).cast("double"))
    return c.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_calls"), T.rounded(F.avg("ok")).alias("tool_call_validity"))


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 60 THEN 1.0::DOUBLE ELSE 0 END AS score FROM events")
def txt24_json_schema_valid(spark, sf_dir):
    schema = json.dumps({"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}, "required": ["k"], "additionalProperties": False})
    return table(spark, sf_dir, "events").select("event_id", J.json_schema_valid("props", schema).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.5 END AS field_f1, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.5 END AS field_precision, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.5 END AS field_recall FROM orders")
def txt25_field_f1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))).alias("a"), F.to_json(F.struct(F.col("o_custkey").cast("double").alias("c"), F.lit("O").alias("s"))).alias("b"))
    return o.select("o_orderkey", J.field_f1("a", "b").alias("s")).select("o_orderkey", "s.*")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(n * 0.7)")
def flt02_first_in_order(spark, sf_dir):
    return P.first_share(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.7, "doc_id")


@query("SELECT event_id, (value < 1 AND event_type IN ('error', 'view')) AS no_answer FROM events")
def flt07_no_answer(spark, sf_dir):
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "length")
    return table(spark, sf_dir, "events").select("event_id", O.no_answer(F.col("value") < 1, reason).alias("no_answer"))


@query("SELECT conv_id, CASE WHEN a = 0 THEN 'trace.tool_calls' WHEN s = 0 THEN 'case.allowed_tools' END AS missing FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY 1)")
def flt08_eligibility(spark, sf_dir):
    def n(role):
        return F.count_if(F.col("role") == role)

    k = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n("assistant").alias("a"), n("system").alias("s"))
    return O.eligibility(k, {"trace.tool_calls": F.col("a") > 0, "case.allowed_tools": F.col("s") > 0}).select("conv_id", "missing")


@query("SELECT o_custkey AS case_id, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1 HAVING avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) >= 0.5")
def flt09_disagreements(spark, sf_dir):
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.lit("O").alias("one"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("other"))
    rates = O.disagreement(verdicts, "case_id").select("case_id", F.col("disagreement_rate").alias("rate"))
    return O.at_least(rates, "rate", 0.5).withColumn("rate", T.rounded("rate"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passed, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def agg27_pass_rates(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("passed"))
    return O.pass_rates(joined, "lang").withColumn("pass_rate", T.rounded("pass_rate"))


#: Results of another harness: 'metric,filter' keys in a map, one of them a standard error.
@query("SELECT c_mktsegment || ':' || 'acc' AS name, round(avg(c_acctbal), 6) AS value FROM customer GROUP BY c_mktsegment UNION ALL SELECT c_mktsegment || ':' || 'acc_norm', round(max(c_acctbal), 6) FROM customer GROUP BY c_mktsegment")
def agg31_harness_results(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.create_map(F.lit("acc,none"), F.avg("c_acctbal"), F.lit("acc_stderr,none"), F.stddev("c_acctbal"), F.lit("acc_norm,strict"), F.max("c_acctbal")).alias("results"))
    return O.harness_results(raw, "c_mktsegment").withColumn("value", T.rounded("value"))


@query("SELECT conv_id, turn, len(list_intersect(regexp_split_to_array(input, ' '), regexp_split_to_array(output, ' ')))::BIGINT AS shared FROM (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")
def set04_shared_tokens(spark, sf_dir):
    return view(spark, sf_dir, CONV).select("conv_id", "turn", T.shared(F.split("input", " "), F.split("output", " ")).cast("long").alias("shared"))


@query(r"""WITH p AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(input, '\s+'), lambda x: x <> '')) AS t, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(output, '\s+'), lambda x: x <> '')), 0, 1 FROM p),
k AS (SELECT conv_id, turn, t, sum(a) AS a, sum(b) AS b FROM t GROUP BY 1, 2, 3) SELECT conv_id, turn, CAST(sum(least(a, b)) AS BIGINT) AS shared FROM k GROUP BY 1, 2""")
def set05_multiset_overlap(spark, sf_dir):
    return view(spark, sf_dir, CONV).select("conv_id", "turn", T.multiset_overlap(T.split("input"), T.split("output")).alias("shared"))


@query("SELECT l_orderkey AS source_id, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def set08_lineage_conflicts(spark, sf_dir):
    return O.lineage_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linestatus"), "source_id", "l_linestatus")


@query(_MSTATS + " SELECT name, model, round(mean, 6) AS score, n, round(std, 6) AS std, row_number() OVER (PARTITION BY name ORDER BY mean DESC, model) AS place FROM s")
def cmp05_per_metric(spark, sf_dir):
    return O.per_metric(model_stats(spark, sf_dir)).withColumns({c: T.rounded(c) for c in ("score", "std")})


@query("SELECT c_mktsegment AS model, count(*) AS n_calls, round(avg(o_totalprice), 4) AS mean_ms, round(quantile_cont(o_totalprice, 0.95), 4) AS p95_ms, round(count(*) / (sum(o_totalprice) / 1000), 9) AS per_second FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def cmp07_performance_table(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = O.performance_table(joined.select(F.col("c_mktsegment").alias("model"), "o_totalprice"), "model", "o_totalprice")
    return found.withColumns({"mean_ms": T.rounded("mean_ms", 4), "p95_ms": T.rounded("p95_ms", 4), "per_second": T.rounded("per_second", 9)})


@query("WITH f AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT f.o_custkey AS case_id, round(g.m / f.m, 6) AS retention FROM f JOIN g ON f.o_custkey = g.o_custkey")
def cmp04_retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f, g = (o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias(n)) for s, n in (("F", "f"), ("O", "g")))
    return f.join(g, "o_custkey").select(F.col("o_custkey").alias("case_id"), T.rounded(C.retention(F.col("g"), F.col("f"))).alias("retention"))


@query("SELECT c_custkey, round(CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0.9 * 1.0 + 0.1 * 0.5 WHEN 'MACHINERY' THEN 0.6 * 0.5 + 0.4 * 0.0 ELSE 1.0 END AS DOUBLE), 6) AS score, CASE c_mktsegment WHEN 'MACHINERY' THEN 'fair' ELSE 'good' END AS label FROM customer")
def jdg13_label_probabilities(spark, sf_dir):
    """Expected score and likeliest label of label probabilities, with labels of the encoder's own names."""
    p = F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("LABEL_0"), F.lit(0.9), F.lit("fair"), F.lit(0.1))).when(F.col("c_mktsegment") == "MACHINERY", F.create_map(F.lit("fair"), F.lit(0.6), F.lit("bad"), F.lit(0.4))).otherwise(F.create_map(F.lit("LABEL_0"), F.lit(0.5), F.lit("other"), F.lit(0.5)))
    found = label_probabilities(p, {"good": 1.0, "fair": 0.5, "bad": 0.0}, {"LABEL_0": "good"})
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("f")).select("c_custkey", T.rounded("f.value").alias("score"), "f.label")


@query("SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'")
def prj11_thinking_strip(spark, sf_dir):
    replies = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>"), F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.strip_thinking(replies).alias("answer"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)[.]html', 1), ''), url) AS scored FROM pages")
def prj13_extracted_or_raw(spark, sf_dir):
    from verdictframe.operators.prompts import extracted, regex_annotation

    return table(spark, sf_dir, "pages").select("page_id", extracted(F.col("url"), regex_annotation(F.col("url"), "/([0-9]+)[.]html", 1)).alias("scored"))


@query("SELECT item_id, 'Q: ' || text || ' / expected: ' AS prompt FROM benchmark")
def prj14_judge_prompt(spark, sf_dir):
    from verdictframe.operators.judges import render

    return table(spark, sf_dir, "benchmark").select("item_id", render("Q: {input} / expected: {expected}", {"input": F.col("text"), "expected": F.lit(None).cast("string")}).alias("prompt"))


@query(
    """WITH m AS (SELECT conv_id, string_agg('[' || role || ']' || CASE WHEN turn % 4 = 1 THEN ' tool_calls: f(' || turn || ') | ' || text ELSE ' ' || text END, chr(10) ORDER BY turn) || CASE WHEN count(*) FILTER (WHERE turn % 4 = 1) = 0 THEN chr(10) || '(no tool calls)' ELSE '' END AS t FROM conversations GROUP BY 1)
SELECT conv_id AS episode_id, sha256(CASE WHEN length(t) <= 1000 THEN t ELSE t[:500] || chr(10) || '...(truncated)...' || chr(10) || right(t, 500) END) AS trace_sha256 FROM m"""
)
def agt13_render_trace(spark, sf_dir):
    calls = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("f("), F.col("turn").cast("string"), F.lit(")")))
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"), calls.alias("calls"))
    return render_trace(messages, 1000).select("episode_id", T.digest("trace").alias("trace_sha256"))


@query("SELECT u.user_id AS probe, count(*) AS total, count(*) FILTER (WHERE value > 300) AS invalid FROM events u GROUP BY 1")
def rtm03_invalid_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("probe"), (F.col("value") > 300).alias("invalid"), F.lit(True).alias("passed"))
    return red_team_summary(rows, "probe").select("probe", "total", "invalid")


def _detect_sql() -> str:
    first = r"regexp_extract(lower(trim(text)), '^([^.!?\n]*[.!?]*)', 1)"
    any_of = lambda parts: "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in parts) + ")"
    # the other engine's word borders know no Arabic letters
    either = lambda es: "(?is)" + "|".join(f"(?:{e})" for e in es).replace("'", "''")
    refusal = f"regexp_matches({first}, '{either(X.REFUSAL)}')"
    leak = f"regexp_matches(text, '{either(X.LEAK)}')"
    any_language = " OR ".join(f"regexp_matches({first}, '{either(es) if lang != 'ar' else either(es).replace(chr(92) + 'b', '')}')" for lang, es in REFUSALS.items())
    return f"SELECT conv_id, turn, {any_of(X.KEYWORDS)} AS keyword, {refusal} AS refusal, {any_of(X.SUCCESS)} AS injection_success, NOT {refusal} AND {leak} AS system_prompt_leak, {any_language} AS refusal_multilingual FROM conversations WHERE role = 'assistant'"


@query(_detect_sql())
def rtm02_detectors(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", *(detect(F.col("text")).alias(name) for name, detect in X.DETECTORS.items()))


@query(None)
def rtm01_probes(spark, sf_dir):
    return X.probes(spark)
