"""URL filters as a temporal list join, in DataFrame functions alone.

A list is a table of dated entries: a pattern (a host, a domain with all its hosts, or a URL prefix), an action (add or
remove) and a verdict (block or allow). Entries become validity intervals: an entry holds from its date until the next
entry of the same pattern, or for ever. A capture looks up the patterns that could match it (its URL's prefixes, its
host and the domains above it, each as deep as the deepest entry of the list) in the intervals that hold at its fetch
time; the most specific one decides (prefixes before hosts before domains), and among equally specific ones the latest.

The join is an equi-join on the pattern with the dates as residual condition. Both sides are shuffled (the list grows
with the crawl, so it is not broadcast). Lookups of a pattern that more than HOT captures share, of whatever kind, are
spread over salts in proportion to their number, by a hash of the capture, and the pattern's entries stand once in
each. How many captures share a pattern is counted with sums before the shuffle. The verdict of a capture is an
aggregate over the capture's own few lookups, combined before the shuffle.

URLs are read as browsers read them: tabs and line ends are dropped, a backslash is a slash, user info (up to the last @
of the authority) and port are no part of the host, an address in brackets is one host, dots at the end of a host don't
count. Addresses in numbers have no domains above them. Percent signs and letters outside ASCII stay as they are.

Defined results: a null or unparsable URL, or a null fetch time, matches nothing and is allowed, with a null entry.
Entries with a null pattern or date are ignored; of several entries of a pattern with one date, the one whose action
and verdict come last in alphabetical order holds. Repeated captures each get a row. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.cluster import broadcast_if_small, cut, only

HOT = 4096
#: Scheme, user info, host (1), port, path (2), and what ends them.
URL = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2,}(?:[^/\\?#]*@)?(\[[^\]/\\?#@]*\]|[^/\\?#:@\[\]]+)(?::[0-9]*)?((?:[/\\][^?#]*)?)(?:[?#]|\z)"
#: Hosts without domains above them.
ADDRESS = r"^(?:[0-9.]+|\[.*)$"


def _read(url: Column) -> Column:
    return F.translate(url, "\t\r\n", "")


def host(url: Column) -> Column:
    """The host in lower case; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(_read(url), URL, 1)), r"\.+$", "")
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.translate(F.regexp_extract(_read(url), URL, 2), "\\", "/")


def patterns(url: Column, prefix_depth: int, domain_depth: int, least_labels: int = 1) -> Column:
    """(pattern, specificity) of every entry up to the depths that could match: URL prefixes, the host, the domains above it.

    Host and path are read once, and handed to what is made of them as the fields of a row.
    """

    def each(least: int, most: Column, make) -> Column:
        ks = F.when(most >= least, F.sequence(F.lit(least), most))
        return F.coalesce(F.transform(ks, make), F.array().cast("array<struct<pattern:string,specificity:int>>"))

    def entry(pattern: Column, specificity: Column) -> Column:
        return F.struct(pattern.alias("pattern"), specificity.cast("int").alias("specificity"))

    def of(read: Column) -> Column:
        h, segments, labels = read["host"], read["segments"], read["labels"]
        prefixes = each(1, F.least(F.size(segments), F.lit(prefix_depth)), lambda k: entry(F.concat(F.lit("prefix:"), h, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")), k + 200))
        domains = each(least_labels, F.least(F.size(labels), F.lit(domain_depth)), lambda k: entry(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")), k))
        return F.when(h.isNotNull(), F.concat(prefixes, F.array(entry(F.concat(F.lit("host:"), h), F.lit(100))), domains))

    def cut_up(read: Column) -> Column:
        labels = F.when(read["host"].rlike(ADDRESS), F.array(read["host"])).otherwise(F.split(read["host"], r"\."))
        return F.struct(read["host"].alias("host"), F.filter(F.split(read["path"], "/"), lambda s: s != "").alias("segments"), labels.alias("labels"))

    read = F.transform(F.array(F.struct(host(url).alias("host"), path(url).alias("path"))), cut_up)
    return F.element_at(F.transform(read, of), 1)


def depths(entries: DataFrame) -> tuple[int, int]:
    """The most path segments of a prefix and the most labels of a domain in a list."""
    pattern = F.col("pattern")
    found = entries.agg(
        F.max(F.when(pattern.startswith("prefix:"), F.size(F.split(pattern, "/")) - 1)).alias("prefix"),
        F.max(F.when(pattern.startswith("domain:"), F.size(F.split(pattern, r"\.")))).alias("domain"),
    ).first()
    return found["prefix"] or 0, found["domain"] or 0


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, verdict, valid_from and valid_to (exclusive; null for ever) of the entries that add something.

    entries has columns pattern, action, verdict and listed_at.
    """
    dated = only(entries, "pattern", "action", "verdict", "listed_at").where("pattern is not null and listed_at is not null")
    one = dated.groupBy("pattern", "listed_at").agg(F.max(F.struct("action", "verdict")).alias("entry"))
    following = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return one.select("pattern", "entry.*", F.col("listed_at").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id") -> DataFrame:
    """Per capture (capture_id, url, fetched_at): the id, url, fetched_at, verdict, matched pattern and valid_from.

    Captures with equal id, url and time are told apart by how often they come.
    """
    rows, entries = only(captures, capture_id, "url", "fetched_at"), cut(only(entries, "pattern", "action", "verdict", "listed_at"))
    grouped = rows.groupBy(capture_id, "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    looked_up = grouped.select("*", F.explode_outer(patterns(F.col("url"), *depths(entries))).alias("p")).select(capture_id, "url", "fetched_at", "copies", F.col("p.pattern").alias("looked_up"), "p.specificity")
    hot, _ = broadcast_if_small(looked_up.groupBy(F.col("looked_up").alias("shared")).agg(F.sum("copies").alias("n")).where(F.col("n") > HOT).select("shared", F.ceil(F.col("n") / HOT).cast("int").alias("salts")))
    salted = looked_up.join(hot, F.col("looked_up") == F.col("shared"), "left").drop("shared")
    looked_up = salted.withColumn("capture_salt", F.coalesce(F.pmod(F.xxhash64("url", capture_id, "fetched_at"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    listed = intervals(entries).join(hot, F.col("pattern") == F.col("shared"), "left").drop("shared")
    held = listed.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")).drop("salts")
    active = (F.col("looked_up") == F.col("pattern")) & (F.col("capture_salt") == F.col("salt")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    found = looked_up.join(held, active, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.substring_index("pattern", ":", 1).alias("kind"), "specificity", "valid_from", "pattern", "verdict"))).alias("best")
    decided = found.groupBy(capture_id, "url", "fetched_at", "copies").agg(best)
    return decided.select(
        capture_id,
        "url",
        "fetched_at",
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.pattern").alias("matched"),
        F.col("best.valid_from").alias("valid_from"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
