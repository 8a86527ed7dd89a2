"""Source divergence audit: how far the term distributions of the sources of a language are from each other.

Each language keeps the V terms that at least MIN_DOCS of its documents hold. A group (language, source), and the
language as a whole, give a term with n occurrences the price p = 1 + floor(10^9 (n + 5) / (N + 5 V)), N being the sum
of n over the kept terms. The distance of two sources is the sum of |p - q| over all V terms, by inclusion and
exclusion over the terms that each of them holds: with c the price of a term that a source lacks,

    V |c_g - c_h|                                               as if both lacked every term,
    + sum over g's terms of |p_g - c_h| - |c_g - c_h|,          and the same for h, one-sided,
    + sum over common terms of |p_g - p_h| - |p_g - c_h| - |c_g - p_h| + |c_g - c_h|.

One-sided sums depend on how often each price occurs in a group alone: they are running sums over that histogram, read
at c_h. Common terms meet in a join of postings by language and term, summed before it is shuffled. No table of all
terms of all sources is made.

Terms are counted in Arrow batches; each task adds up what it can hold (PENDING rows) before it sends anything, and
from there on everything is a DataFrame. All arithmetic is in integers; prices divide decimals of 38 digits.

Defined results: null text, lang and source count as ''. A repeated row counts as often as it comes, as a document of
its own. A group without a kept term gives every term c; a language without kept terms has distance 0 everywhere. A
language with one source has no pairs. An empty table has no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.cluster import broadcast_if_small, cut, only
from verdictframe.llm.text_kernel import word_chunks

MIN_DOCS, SCALE, SMOOTH, TOP_TERMS = 30, 1_000_000_000, 5, 50
_BYTE = np.arange(256)
#: Bytes of terms: ASCII letters and everything outside ASCII.
LETTERS = (_BYTE >= 0x80) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
#: A task adds up so many rows before it sends them on.
PENDING = 200_000
CHUNK = 2 << 20


def _texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    values = np.ascontiguousarray(data[at])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values))


class _Counts:
    """Occurrences and documents of the terms of groups, added up within bounds."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, group: np.ndarray, hashes: np.ndarray, n: np.ndarray, docs: np.ndarray, terms: pa.Array) -> None:
        self.parts.append((group, hashes, n, docs, terms))
        self.rows += len(group)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        group, hashes, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        terms = pa.concat_arrays([p[4] for p in self.parts])
        order = np.lexsort((group, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
        at = np.flatnonzero(new)
        first = order[at]
        self.parts, self.rows = [], 0
        self.add(group[first], hashes[first], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at), terms.take(pa.array(first)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for group, _, n, docs, terms in self.parts:
            for lo in range(0, len(group), 50_000):
                part = slice(lo, lo + 50_000)
                which = pa.array(group[part])
                yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), terms[lo : lo + 50_000].cast(pa.string()), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
        self.groups, self.parts, self.rows = {}, [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Counts()
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for at, words in word_chunks(batch.column(2), LETTERS, lower=True, limit=CHUNK):
            if not len(words.starts):
                continue
            group = np.array([total.groups.setdefault(g, len(total.groups)) for g in names[at : at + words.n_docs]], np.int64)
            hashes = words.hashes()
            order = np.lexsort((words.doc, group[words.doc], hashes))
            h, d = hashes[order], words.doc[order]
            g = group[d]
            new_term = np.ones(len(h), bool)
            new_term[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            new_doc = new_term.copy()
            new_doc[1:] |= d[1:] != d[:-1]
            first = np.flatnonzero(new_term)
            n, docs = np.diff(np.append(first, len(h))), np.add.reduceat(new_doc.astype(np.int64), first)
            at_word = order[first]
            total.add(g[first], h[first], n, docs, _texts_of(words.data, words.starts[at_word], words.ends[at_word]))
        if total.rows > 2 * PENDING:
            total.merge()
            if total.rows > PENDING:
                yield from total.flush()
    yield from total.flush()


def _named(documents: DataFrame, *columns: str) -> DataFrame:
    return only(documents, *columns).select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def postings(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n of the kept terms, with lang_n (occurrences in the language) and leads (once a term)."""
    counted = _named(documents, "lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    held = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = held.select("*", F.sum("docs").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).alias("leads"))
    return cut(kept.where(F.col("df") >= min_docs).drop("df", "docs"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 5) / (total + 5 terms)), exactly; null if there is no term."""
    wide = "decimal(20,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast(wide)
    return F.when(terms > 0, F.call_function("div", above, (total + SMOOTH * terms).cast(wide)) + 1)


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, low, high (sources in order) and value (their distance)."""
    absent = groups.select("lang", "source", "c", "v")
    other = absent.select(F.col("lang").alias("other_lang"), F.col("source").alias("other"), F.col("c").alias("other_c"))
    facing = absent.join(other, (F.col("lang") == F.col("other_lang")) & (F.col("source") != F.col("other"))).drop("other_lang")
    histogram = held.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("m"))
    # where no term is kept, prices are null and distances 0
    probes = facing.select("lang", "source", F.coalesce("other_c", F.lit(0)).alias("at"), F.lit(0).cast("long").alias("m"), "other", F.coalesce("c", F.lit(0)).alias("c"), "v")
    merged = histogram.select("lang", "source", "at", "m", F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("v")).unionByName(probes)
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = merged.select(
        "*",
        F.sum("m").over(upto).alias("n_le"),
        F.sum(F.col("m") * F.col("at")).over(upto).alias("s_le"),
        F.sum("m").over(whole).alias("n_all"),
        F.sum(F.col("m") * F.col("at")).over(whole).alias("s_all"),
    ).where("other is not null")
    apart = F.abs(F.col("c") - F.col("at"))
    one_sided = F.col("at") * (2 * F.col("n_le") - F.col("n_all")) + F.col("s_all") - 2 * F.col("s_le") - F.col("n_all") * apart
    both_absent = F.when(F.col("source") < F.col("other"), F.col("v") * apart).otherwise(0)
    low_high = F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")
    sparse = sums.select("lang", *low_high, (one_sided + both_absent).alias("value"))

    a = held.select("lang", "term", F.col("source").alias("low"), F.col("p").alias("p_low"), F.col("c").alias("c_low"))
    b = held.select(F.col("lang").alias("lang_b"), F.col("term").alias("term_b"), F.col("source").alias("high"), F.col("p").alias("p_high"), F.col("c").alias("c_high"))
    common = a.join(b, (F.col("lang") == F.col("lang_b")) & (F.col("term") == F.col("term_b")) & (F.col("low") < F.col("high")))
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    overlap = common.groupBy("lang", "low", "high").agg(F.sum(far("p_low", "p_high") - far("p_low", "c_high") - far("c_low", "p_high") + far("c_low", "c_high")).alias("value"))
    return sparse.unionByName(overlap).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    counted = postings(documents, min_docs)
    of_lang = counted.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    of_group = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = _named(documents, "lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sized = every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total").alias("total"), zero("v").alias("v"), zero("lang_total").alias("lang_total"))
    groups, _ = broadcast_if_small(sized.withColumn("c", price(F.lit(0), F.col("total"), F.col("v"))))
    priced = counted.join(groups, ["lang", "source"]).select("lang", "source", "term", "c", price(F.col("n"), F.col("total"), F.col("v")).alias("p"), price(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    held = cut(priced)

    pairs = _pairs(held, groups)
    both = F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))
    sided = pairs.select("lang", F.inline(both), "value")
    terms = held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair_rows = sided.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
    term_rows = terms.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")).select(*columns)
    return pair_rows.unionByName(term_rows)
