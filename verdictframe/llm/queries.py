"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.llm import chat, filter_audit, language, license_scan, packing, pii, quality_classifier, quality_rules, source_audit, url_filter, warc
from verdictframe.llm.cluster import cut, read
from verdictframe.llm.decontaminate import report
from verdictframe.llm.near_dedup import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def captures(pages: DataFrame) -> DataFrame:
    """pages with a day of 2024 as their fetch time, which the table lacks."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_at"))


#: Prefixes and domains of the list are as deep as this, which is deeper than the pages' URLs.
LIST_DEPTH = 32


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the patterns that occur in pages: every host, and every domain and prefix of any depth.

    Each pattern has up to three entries; actions, verdicts and days follow from digests of the pattern.
    """
    found = pages.select(F.explode(url_filter.patterns(F.col("url"), LIST_DEPTH, LIST_DEPTH, 2)).alias("p"))
    patterns = found.select("p.pattern").distinct()
    k = F.col("k").cast("string")
    numbered = patterns.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    drawn = numbered.select("pattern", "k", F.conv(F.substring(F.md5(F.concat("pattern", F.lit("#"), k)), 1, 4), 16, 10).cast("int").alias("m"))
    return drawn.where("m % 4 <> 3").select(
        "pattern",
        F.when(F.col("k") == 1, "remove").otherwise("add").alias("action"),
        F.when(F.col("m") % 3 == 0, "allow").otherwise("block").alias("verdict"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("m") % 366).alias("listed_at"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.evaluate(captures(pages), list_entries(pages))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records' headers, and a digest of each whole record in place of its bytes."""
    return warc.build(read(spark, sf_dir, "pages")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recovered of the conversations' turns, with the turns and their canonical rendering."""
    blocks = cut(chat.transcripts(read(spark, sf_dir, "conversations")))
    return chat.recovered(blocks, chat.learn(blocks.where(~chat.held_out()))).withColumn("held_out", chat.held_out())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_warc_derivatives,
        op3_quality_rules,
        op4_near_duplicates,
        op5_best_fit_packing,
        op6_language_id,
        op7_chat_format,
        op8_license_scan,
        op9_quality_classifier,
        op10_decontamination,
        op11_pii,
        op12_source_divergence,
        op13_filter_interaction,
    )
}

# the parts of a URL, for another engine's regular expressions
_URL = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2,}(?:[^/\\?#]*@)?(\[[^\]/\\?#@]*\]|[^/\\?#:@\[\]]+)(?::[0-9]*)?((?:[/\\][^?#]*)?)(?:[?#]|\z)"

SQL: dict[str, str] = {
    "op1_url_filter": rf"""
WITH cleaned AS (SELECT page_id, url, regexp_replace(url, '[\t\r\n]', '', 'g') AS u FROM pages),
parsed AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_at,
         regexp_replace(lower(regexp_extract(u, '{_URL}', 1)), '\.+$', '') AS h,
         list_filter(string_split(replace(regexp_extract(u, '{_URL}', 2), '\', '/'), '/'), lambda s: s <> '') AS seg
  FROM cleaned),
labels AS (SELECT *, CASE WHEN regexp_matches(h, '^(?:[0-9.]+|\[.*)$') THEN [h] ELSE string_split(h, '.') END AS lab FROM parsed WHERE h <> ''),
lookups AS (
  SELECT page_id, url, fetched_at, 'host:' || h AS pattern, 100 AS specificity FROM labels
  UNION ALL SELECT page_id, url, fetched_at, 'prefix:' || h || '/' || array_to_string(seg[1:k], '/'), 200 + k
  FROM labels, LATERAL (SELECT unnest(range(1, least(len(seg), {LIST_DEPTH}) + 1)) AS k)
  UNION ALL SELECT page_id, url, fetched_at, 'domain:' || array_to_string(lab[-k:], '.'), k
  FROM labels, LATERAL (SELECT unnest(range(2, least(len(lab), {LIST_DEPTH}) + 1)) AS k)),
patterns AS (SELECT DISTINCT pattern FROM lookups),
drawn AS (
  SELECT pattern, k, CAST('0x' || substr(md5(pattern || '#' || k), 1, 4) AS INTEGER) AS m
  FROM patterns, (VALUES (0), (1), (2)) AS t(k)),
entries AS (
  SELECT pattern, CASE WHEN k = 1 THEN 'remove' ELSE 'add' END AS action, CASE WHEN m % 3 = 0 THEN 'allow' ELSE 'block' END AS verdict,
         DATE '2024-01-01' + CAST(m % 366 AS INTEGER) AS listed_at
  FROM drawn WHERE m % 4 <> 3),
one AS (
  SELECT pattern, listed_at, max(action || ':' || verdict) AS entry FROM entries GROUP BY 1, 2),
held AS (
  SELECT pattern, split_part(entry, ':', 1) AS action, split_part(entry, ':', 2) AS verdict, listed_at AS valid_from,
         lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to
  FROM one),
found AS (
  SELECT l.page_id, l.url, l.fetched_at, l.specificity, h.pattern, h.verdict, h.valid_from
  FROM lookups l JOIN held h ON l.pattern = h.pattern AND h.action = 'add'
   AND l.fetched_at >= h.valid_from AND (h.valid_to IS NULL OR l.fetched_at < h.valid_to)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY specificity DESC, valid_from DESC, pattern DESC, verdict DESC) AS rn FROM found)
SELECT p.page_id, p.url, p.fetched_at, coalesce(b.verdict, 'allow') AS verdict, b.pattern AS matched, b.valid_from
FROM parsed p LEFT JOIN best b ON b.rn = 1 AND p.page_id = b.page_id AND p.url = b.url AND p.fetched_at = b.fetched_at
""",
    "op12_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {source_audit.MIN_DOCS}),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM cells),
priced AS (
  SELECT lang, source, term, n,
         CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS BIGINT) AS q
  FROM summed),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM priced WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {source_audit.TOP_TERMS}
""",
    "op13_filter_interaction": r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
masks AS (
  SELECT r.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN r.doc_id > min(r.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM raw r LEFT JOIN marked m ON m.doc_id = r.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY 1, 2),
orders(o) AS (
  SELECT ''
  UNION ALL
  SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(c) WHERE strpos(o, c) = 0),
steps AS (
  SELECT c.*, o AS filter_order, s AS step, o[s] AS filter, 1 << (strpos('ABCDE', o[s]) - 1) AS bit
  FROM cells c, orders, (VALUES (1), (2), (3), (4), (5)) t(s) WHERE length(o) = 5),
seen AS (
  SELECT *, mask & bit AS fails, coalesce(bit_or(mask & bit) OVER (PARTITION BY part, mask, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
figures AS (
  SELECT part, filter_order, step, filter,
         CAST(sum(CASE WHEN (before | fails) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fails > 0 AND before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails > 0 AND before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fails > 0 AND before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fails > 0 AND before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM figures
""",
}
