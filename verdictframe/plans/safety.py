"""Secrets, refusals and red-team results over the shared tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.functions.text import entropy
from verdictframe.operators import redteam as X
from verdictframe.operators import safety as S
from verdictframe.operators.refusals import multilingual_refusal
from verdictframe.plans.registry import query, table, view

_FOUND = "SELECT lang, '{0}' AS kind, len(regexp_extract_all(text, '{1}')) AS n FROM documents"
#: All that is looked for. The other engine's patterns can't look around: its bearer tokens have no least length.
PATTERNS = [*S.SECRETS, *S.PERSONAL]
_RE2 = [(s.kind, re.sub(r"\(\?(?:=|<!)[^()]*\)", "", s.pattern)) for s in PATTERNS]


@query("WITH f AS (" + " UNION ALL ".join(_FOUND.format(k, p) for k, p in _RE2) + ") SELECT lang, kind, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2 HAVING sum(n) > 0")
def sec02_secret_counts(spark, sf_dir):
    return S.secret_counts(table(spark, sf_dir, "documents"), "lang", patterns=PATTERNS)


def _nested(sql: str) -> str:
    for _, p in _RE2:
        sql = f"regexp_replace({sql}, '{p}', '{S.MASK}', 'g')"
    return sql


#: Tokens of high entropy of a text, and a text with them masked, for the other engine.
_TOKENS = f"list_filter(regexp_extract_all({{0}}, '{S.TOKEN}'), lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_full_match(lower(t), '[0-9a-f]{{{{32}}}}|[0-9a-f]{{{{40}}}}|[0-9a-f]{{{{64}}}}|[0-9a-f]{{{{8}}}}(-[0-9a-f]{{{{4}}}}){{{{3}}}}-[0-9a-f]{{{{12}}}}') AND list_aggregate(string_split(t, ''), 'entropy') >= 4)".replace("{32,}={0,2}", "{{32,}}={{0,2}}")
_MASKED = "list_reduce(list_prepend({0}, " + _TOKENS + f"), lambda a, t: replace(a, t, '{S.MASK}'))"


@query(f"WITH r AS (SELECT doc_id, text, {_nested('text')} AS plain FROM documents), m AS (SELECT doc_id, text, {_MASKED.format('plain')} AS redacted FROM r) SELECT doc_id, sha256(redacted) AS redacted_sha256, redacted <> text AS changed FROM m")
def sec01_redact(spark, sf_dir):
    # the masked text is a column of its own, so that it is made once
    masked = table(spark, sf_dir, "documents").select("doc_id", "text", S.redact(F.col("text"), patterns=PATTERNS).alias("masked"))
    return masked.select("doc_id", F.sha2("masked", 256).alias("redacted_sha256"), (F.col("masked") != F.col("text")).alias("changed"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{S.TOKEN}')) AS n_tokens FROM documents")
def sec01_long_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.long_tokens("text")).cast("long").alias("n_tokens"))


#: Events as settings of an agent: by key names, every third one holds a credential and every second one a number that only counts.
_SETTINGS = """SELECT event_id, chr(123) || '"' || CASE event_id % 3 WHEN 0 THEN 'api_key' WHEN 1 THEN 'note' ELSE 'pin' END || '":' || CAST(user_id AS STRING) || ',"password_' || CASE event_id % 2 WHEN 0 THEN 'length' ELSE 'hint' END || '":8,"list":["AKIA' || CASE event_id % 5 WHEN 0 THEN 'ABCDEFGHIJKLMNOP' ELSE 'x' END || '"]' || chr(125) AS doc FROM {events}"""


@query(
    """WITH k AS (SELECT event_id, unnest(list_concat(
 CASE event_id % 3 WHEN 0 THEN ['api_key|api_key|secret_key_name'] WHEN 1 THEN [] ELSE ['pin|pin|secret_key_name'] END,
 [CASE event_id % 2 WHEN 0 THEN 'password_length|password_length|secret_key_name' ELSE 'password_hint|password_hint|secret_key_name' END],
 CASE event_id % 5 WHEN 0 THEN ['list[0]|list|aws_access_key_id'] ELSE [] END)) AS f FROM events)
SELECT event_id, split_part(f, '|', 1) AS path, split_part(f, '|', 2) AS key, split_part(f, '|', 3) AS kind FROM k"""
)
def agg32_secret_paths(spark, sf_dir):
    return view(spark, sf_dir, _SETTINGS).select("event_id", F.explode(S.json_secrets("doc")).alias("f")).select("event_id", "f.path", "f.key", "f.kind")


@query(
    """SELECT event_id, '{"' || CASE event_id % 3 WHEN 0 THEN 'api_key": "[REDACTED]"' WHEN 1 THEN 'note": ' || user_id ELSE 'pin": "[REDACTED]"' END || ', "password_' || CASE event_id % 2 WHEN 0 THEN 'length": 8' ELSE 'hint": "[REDACTED]"' END
 || ', "list": ["' || CASE event_id % 5 WHEN 0 THEN '[REDACTED]' ELSE 'AKIAx' END || '"]}' AS shown FROM events"""
)
def sec01_redact_json(spark, sf_dir):
    return view(spark, sf_dir, _SETTINGS).select("event_id", S.redact_json("doc").alias("shown"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, unnest(string_split(c_name, '')) AS ch FROM customer), k AS (SELECT c_custkey, length(c_name) AS n, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2, 3)
SELECT c_custkey, round(-sum(k::DOUBLE / n * log2(k::DOUBLE / n)), 6) AS entropy FROM k GROUP BY 1"""
)
def fn07_entropy(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.rounded(entropy("c_name")).alias("entropy"))


#: Replies in the languages of refusals, some of them refusals (in English, too), one in a language without phrases.
_REPLIES = [
    ("en", "I’m sorry, I can’t do that. More.", 1.0),
    ("en", "Here it is. I cannot say more.", 0.0),
    ("hi", "माफ़ कीजिए, यह नहीं होगा।", 1.0),
    ("hi", "यह रहा उत्तर। माफ़ कीजिए", 0.0),
    ("hi-Latn", "Mujhe khed hai, nahi.", 1.0),
    ("bn", "দুঃখিত, এটা পারব না।", 1.0),
    ("ta", "மன்னிக்கவும், முடியாது.", 1.0),
    ("ar", "لا أستطيع المساعدة.", 1.0),
    ("sw", "Samahani, hapana.", 1.0),
    ("sw", "I must decline this.", 1.0),
    ("zh", "I am sorry.", None),
    ("ta", "<think>x</think> ", None),
]


def _case(values) -> str:
    return "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else repr(v) if isinstance(v, float) else f"'{v}'") for k, v in enumerate(values)) + " END"


@query(f"SELECT event_id, CAST({_case([v for *_, v in _REPLIES])} AS DOUBLE) AS refused, CASE event_id % 12 WHEN 10 THEN 'not_tested' WHEN 11 THEN 'not_measured' END AS status FROM events")
def txt33_refusal(spark, sf_dir):
    rows = view(spark, sf_dir, f"SELECT event_id, {_case([x for x, *_ in _REPLIES])} AS lang, {_case([x for _, x, _ in _REPLIES])} AS reply FROM {{events}}")
    return rows.select("event_id", multilingual_refusal(F.col("reply"), F.col("lang")).alias("r")).select("event_id", F.col("r.value").alias("refused"), "r.status")


@query(
    "WITH m(probe, detector, pattern) AS (VALUES ('user', 'yelling', '[a-z]{12}'), ('assistant', 'question', '[?]'), ('assistant', 'edge', 'heedea')), r AS (SELECT m.probe, m.detector, NOT regexp_matches(lower(text), pattern) AS ok FROM conversations c JOIN m ON c.role = m.probe) SELECT probe, detector, count(*) AS total, 0::BIGINT AS invalid, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS pass_rate FROM r GROUP BY 1, 2"
)
def rtm03_red_team(spark, sf_dir):
    """Probes with patterns of their own; rtm02_detectors has the library's."""
    detectors = spark.createDataFrame([("user", "yelling", "[a-z]{12}"), ("assistant", "question", "[?]"), ("assistant", "edge", "heedea")], "probe string, detector string, pattern string")
    replies = table(spark, sf_dir, "conversations").select(F.col("role").alias("probe"), F.col("text").alias("reply"))
    return S.red_team_summary(S.probe_results(replies, detectors), "probe", "detector")


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fn06_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.digest("text").alias("digest"), T.digest("text", 16).alias("fingerprint"))


@query("SELECT item_id, base64(encode(text)) AS encoded, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot13 FROM benchmark")
def fn10_encodings(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.encoded(F.col("text"), "base64").alias("encoded"), X.encoded(F.col("text"), "rot13").alias("rot13"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(json_object('a', json_array(1, json_object('b', event_id))), '$.a[1].b') AS nested FROM events")
def fn05_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_path("props", "k").try_cast("long").alias("k"), T.json_path(F.concat(F.lit('{"a":[1,{"b":'), F.col("event_id").cast("string"), F.lit("}]}")), "a[1].b").alias("nested"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '-?[0-9][0-9,]*(?:[.][0-9]+)?')) AS n_numbers, CAST(list_sum(list_transform(regexp_extract_all(html, '-?[0-9][0-9,]*(?:[.][0-9]+)?'), lambda x: length(x))) AS BIGINT) AS n_characters FROM pages")
def fn08_numbers(spark, sf_dir):
    found = T.numbers("html")
    length = F.aggregate(F.transform(found, lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_numbers"), F.when(F.size(found) > 0, length).alias("n_characters"))
