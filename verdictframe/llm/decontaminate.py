"""Benchmark decontamination by training suffix arrays.

Each task takes its share of the training texts in chunks (the shards). Prefix doubling (1, 2, 4, 8 words, then 8 + 2)
sorts the shard's own suffixes (those of words that test items have, too) as far as a window goes. Every distinct test
window, of whose words none is missing from the shard, is binary-searched in that array, and the range between its lower
and upper bound has the places where it stands: hits, items and matches come from these ranges alone. The words that
windows cover are the only ones that a longer match can touch; their suffixes, and those of the test items concerned,
are brought into full order, every test suffix is binary-searched in it, and each training suffix has its longest match
with one of the two test suffixes between which it stands. Matches that lie inside a longer one are left out, so there
are never more matches than words, however often text and items repeat themselves. Equal test windows are one entry,
with the set of items that hold it.

The test set is read in blocks of about BLOCK_WORDS words. One block is one streamed pass without a shuffle. More
blocks are passes one after another, each holding one block (driver and tasks); what each finds, keyed by a digest of
the text, is written to the shared folder and joined to the rows at the end.

Defined results: null and empty texts have no words and are never contaminated; a test item without words matches
nothing; items with the same id are one item, and a null id counts as the empty string; further columns of either
input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import ddl, ensure_checkpoint_dir, only
from verdictframe.llm.text_kernel import ALNUM, U64, mix, word_chunks

BLOCK_WORDS = 500_000
FOUND = {"spans": "array<struct<start:long, length:long>>", "items": "array<string>", "matches": "array<struct<item_id:string, item_start:long, start:long, length:long>>"}


def _rank(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + the place of each key in a sorted table of distinct keys; 0 where it isn't there."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at + 1, 0)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Windows:
    """The distinct windows of one length: their places, and the items that hold them; widths are the runs that make them up."""

    def __init__(self, length: int, widths: list[int], rank: np.ndarray, at: np.ndarray, item: np.ndarray):
        self.length, self.widths = length, widths
        order = np.lexsort((at, rank))
        self.places = at[order]
        self.first = np.searchsorted(rank[order], np.arange(1, int(rank.max(initial=0)) + 2))
        # windows held by the same items are one class, so that a text meets each set of items once
        pairs = np.unique(_pair(rank, item[at]))
        holder, owner = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.searchsorted(holder, np.arange(1, len(self.first) + 1))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(owner.astype(U64) + U64(1)))])
        _, example, self.kind = np.unique(sums[first[1:]] - sums[first[:-1]], return_index=True, return_inverse=True)
        self.owner, self.owner_first, self.owner_n = owner, first[example], first[example + 1] - first[example]


class TestSet:
    """Words of the test items one after another, and their distinct windows."""

    __test__ = False

    def __init__(self, ids: list, texts: list[str | None], window: int):
        names = ["" if i is None else str(i) for i in ids]
        self.ids = sorted(set(names))
        code = {name: k for k, name in enumerate(self.ids)}
        hashes, row, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, words in word_chunks(pa.array(texts, pa.string()), ALNUM, lower=True):
            hashes.append(words.hashes())
            row.append(words.doc + lo)
            place.append(np.arange(len(words.doc)) - words.first()[:-1][words.doc])
        h, row, self.place = np.concatenate(hashes), np.concatenate(row), np.concatenate(place)
        self.window = window
        self.item = np.array([code[n] for n in names], np.int64)[row] if len(row) else row
        counts = np.bincount(row, minlength=len(ids)) if len(h) else np.zeros(len(ids), np.int64)
        self.left = counts[row] - self.place if len(h) else np.zeros(0, np.int64)
        self.vocabulary = np.unique(h)
        ranks = _rank(self.vocabulary, h)
        self.words, by_width, width = ranks, {1: ranks}, 1
        while width * 2 <= window:
            pairs = _pair(ranks, self._shifted(ranks, width))
            pairs[self.left < 2 * width] = -1
            ranks, width = _rank(np.unique(pairs[pairs >= 0]), pairs), width * 2
            by_width[width] = ranks
        self.by_length = [self._windows(n, by_width) for n in sorted({int(min(n, window)) for n in counts if n})]

    def _shifted(self, ranks: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(ranks)
        out[: max(0, len(ranks) - by)] = ranks[by:]
        return out

    def _windows(self, length: int, by_width: dict[int, np.ndarray]) -> Windows:
        at = np.flatnonzero(self.left >= length if length == self.window else (self.place == 0) & (self.left == length))
        widths, done = [], 0
        while done < length:
            widths.append(max(w for w in by_width if w <= length - done))
            done += widths[-1]
        rank, done = by_width[widths[0]][at], widths[0]
        for w in widths[1:]:
            rank, done = np.unique(_pair(rank, by_width[w][at + done]), return_inverse=True)[1] + 1, done + w
        # without gaps, where longer items hold runs of this width
        return Windows(length, widths, np.unique(rank, return_inverse=True)[1] + 1, at, self.item)


class Shard:
    """The suffixes of a shard's words that test items have, too, ordered by prefix doubling, and the search of test windows in them.

    ranks[w] has the place of each run of w words among the shard's own distinct runs, 0 where a word is missing from
    the test items or the text ends; tables[w] has these runs as pairs of ranks of half the width.
    """

    def __init__(self, test: TestSet, hashes: np.ndarray, left: np.ndarray):
        self.test, self.left = test, left
        self.words = _rank(test.vocabulary, hashes)
        width = 1
        self.ranks, self.tables = {1: self.words}, {}
        while width * 2 <= test.window:
            r = self.ranks[width]
            on = np.flatnonzero((r[:-width] > 0) & (r[width:] > 0) & (left[:-width] >= 2 * width)) if len(r) > width else np.zeros(0, np.int64)
            rank = np.zeros_like(r)
            self.tables[2 * width], inverse = np.unique(_pair(r[on], r[on + width]), return_inverse=True)
            rank[on] = inverse + 1
            width *= 2
            self.ranks[width] = rank

    def _of_test(self, places: np.ndarray, length: int) -> dict[int, np.ndarray]:
        """Ranks of the runs of test words under windows at places, searched in the shard's tables."""
        words = self.test.words
        under = np.unique((places[:, None] + np.arange(length)).ravel())
        ranks, width = {1: words}, 1
        while width * 2 <= length:
            r, rank = ranks[width], np.zeros_like(words)
            on = under[under + 2 * width <= len(words)]
            on = on[(r[on] > 0) & (r[on + width] > 0) & (self.test.left[on] >= 2 * width)]
            rank[on] = _rank(self.tables[2 * width], _pair(r[on], r[on + width]))
            width *= 2
            ranks[width] = rank
        return ranks

    def search(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard, ascending, and ranks of the test windows that stand there.

        The suffixes long enough are sorted by their first words; the lower and upper bound of each test window in
        that order enclose the places where it stands.
        """
        none = np.zeros(0, np.int64)
        has = np.zeros(len(self.test.vocabulary) + 1, bool)
        has[self.words] = True
        missing = np.concatenate([[0], np.cumsum(~has[self.test.words])])
        window = w.places[w.first[:-1]]
        number = np.flatnonzero(missing[window + w.length] == missing[window])  # the others miss a word
        at = np.flatnonzero((self.ranks[w.widths[0]] > 0) & (self.left >= w.length))
        if not len(number) or not len(at):
            return none, none
        window = window[number]
        theirs = self._of_test(window, w.length)
        here, there, done = self.ranks[w.widths[0]][at], theirs[w.widths[0]][window], w.widths[0]
        for width in w.widths[1:]:
            ok, known = self.ranks[width][at + done] > 0, (there > 0) & (theirs[width][window + done] > 0)
            at, here, number, window, there = at[ok], here[ok], number[known], window[known], there[known]
            table, inverse = np.unique(_pair(here, self.ranks[width][at + done]), return_inverse=True)
            here, there = inverse + 1, _rank(table, _pair(there, theirs[width][window + done]))
            done += width
        number, there = number[there > 0], there[there > 0]
        array = np.argsort(here, kind="stable")
        ordered = here[array]
        lower, upper = np.searchsorted(ordered, there, side="left"), np.searchsorted(ordered, there, side="right")
        place, rank = at[array[_ranges(lower, upper - lower)]], np.repeat(number + 1, upper - lower)
        order = np.argsort(place, kind="stable")
        return place[order], rank[order]


class Order:
    """Suffixes of runs of words that stand one after another, in lexicographic order, by prefix doubling."""

    def __init__(self, words: np.ndarray, left: np.ndarray):
        """left: how many words each suffix has to the end of its run."""
        self.left, width = left, 1
        self.levels = [np.unique(words, return_inverse=True)[1] + 1]
        while width < left.max(initial=0) and self.levels[-1].max() < len(words):
            r = self.levels[-1]
            behind = np.zeros_like(r)
            on = np.flatnonzero(left > width)
            behind[on] = r[on + width]
            self.levels.append(np.unique(_pair(r, behind), return_inverse=True)[1] + 1)
            width *= 2
        self.rank = self.levels[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many leading words the suffixes a and b share."""
        n, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for k in range(len(self.levels) - 1, -1, -1):
            while True:  # the widest level may stand more than once in the length
                go = np.flatnonzero(n + (1 << k) <= most)
                go = go[self.levels[k][a[go] + n[go]] == self.levels[k][b[go] + n[go]]]
                if not len(go):
                    break
                n[go] += 1 << k
        return n


def longest(test: TestSet, full: Windows, words: np.ndarray, at: np.ndarray, rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, length, test word of the longest matches of at least a window that lie in no longer one; windows at at, of rank."""
    size = full.length

    def covered(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words under windows, and whether each is the last of its run."""
        place = np.unique((starts[:, None] + np.arange(size)).ravel())
        return place, np.append(np.diff(place) != 1, True)

    def to_end(last: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(last)
        return ends[np.searchsorted(ends, np.arange(len(last)))] - np.arange(len(last)) + 1

    here, last = covered(at)
    last[:-1] |= doc[here[1:]] != doc[here[:-1]]
    seen = np.unique(rank) - 1
    places = full.places[_ranges(full.first[seen], full.first[seen + 1] - full.first[seen])]
    there, end = covered(places)
    end[:-1] |= test.place[there[1:]] == 0
    n = len(here)
    order = Order(np.concatenate([words[here], test.words[there]]), np.concatenate([to_end(last), to_end(end)]))
    array = np.argsort(order.rank[:n], kind="stable")  # the suffix array of the shard
    tests = n + np.argsort(order.rank[n:], kind="stable")
    insert = np.searchsorted(order.rank[:n][array], order.rank[tests], side="left")  # every test suffix, searched in it
    place_in_array = np.empty(n, np.int64)
    place_in_array[array] = np.arange(n)
    starts = np.searchsorted(here, at)
    after = np.searchsorted(insert, place_in_array[starts], side="right")
    length, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for shift in (-1, 0):
        neighbour = after + shift
        ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(tests)))
        common = order.common(starts[ok], tests[neighbour[ok]])
        better = common > length[ok]
        length[ok[better]], best[ok[better]] = common[better], there[tests[neighbour[ok[better]]] - n]
    end_at = np.maximum.accumulate(np.concatenate([[-1], (at + length)[:-1]])) if len(at) else at
    keep = (at + length > end_at) | (np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]]) if len(at) else np.zeros(0, bool))
    return at[keep], length[keep], best[keep]


def _list(doc: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of values that come text by text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)), values)


def scan_texts(test: TestSet, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """n_words, spans, items and matches of the texts of a column."""
    rows = len(column)
    counts = np.zeros(rows, np.int64)
    spans, items, matches = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 5), np.int64)]
    for lo, words in word_chunks(column, ALNUM, lower=True):
        counts[lo : lo + words.n_docs] = words.counts
        if not len(words.starts) or not test.by_length:
            continue
        first, doc = words.first(), words.doc
        left = first[1:][doc] - np.arange(len(doc))
        shard = Shard(test, words.hashes(), left)
        steps = np.zeros(len(doc) + 1, np.int64)
        for w in test.by_length:
            at, rank = shard.search(w)
            if not len(at):
                continue
            np.add.at(steps, at, 1)
            np.add.at(steps, at + w.length, -1)
            held = np.unique(_pair(doc[at], w.kind[rank - 1]))
            which = held & 0xFFFFFFFF
            n = w.owner_n[which]
            items.append(np.stack([np.repeat((held >> 32) + lo, n), w.owner[_ranges(w.owner_first[which], n)]], axis=1))
            if w.length == test.window:
                start, length, q = longest(test, w, shard.words, at, rank, doc)
            else:
                start, length, q = at, np.full(len(at), w.length), w.places[w.first[rank - 1]]
            matches.append(np.stack([doc[start] + lo, start - first[:-1][doc[start]], length, test.item[q], test.place[q]], axis=1))
        hit = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        if len(hit):
            new = np.append(True, (np.diff(hit) != 1) | (doc[hit[1:]] != doc[hit[:-1]]))
            begin = hit[new]
            size = np.diff(np.append(np.flatnonzero(new), len(hit)))
            spans.append(np.stack([doc[begin] + lo, begin - first[:-1][doc[begin]], size], axis=1))
    s, i = np.concatenate(spans), np.unique(np.concatenate(items), axis=0)
    m = np.concatenate(matches)
    m = m[np.lexsort((m[:, 4], m[:, 3], m[:, 2], m[:, 1], m[:, 0]))]
    names = pa.array(test.ids, pa.string())
    struct = pa.StructArray.from_arrays
    return (
        pa.array(counts),
        _list(s[:, 0], rows, struct([pa.array(s[:, 1]), pa.array(s[:, 2])], names=["start", "length"])),
        _list(i[:, 0], rows, names.take(pa.array(i[:, 1]))),
        _list(m[:, 0], rows, struct([names.take(pa.array(m[:, 3])), pa.array(m[:, 4]), pa.array(m[:, 1]), pa.array(m[:, 2])], names=["item_id", "item_start", "start", "length"])),
    )


def _scanned(df: DataFrame, test: TestSet) -> DataFrame:
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *scan_texts(test, batch.column(at))], names=[*batch.schema.names, "n_words", "spans", "items", "matches"])

    return df.mapInArrow(run, ", ".join([ddl(df), "n_words long", *(f"{c} {t}" for c, t in FOUND.items())]))


def _test_set(items: DataFrame, window: int) -> TestSet:
    rows = items.select("item_id", "text").collect()
    return TestSet([r[0] for r in rows], [r[1] for r in rows], window)


def _items(benchmark: DataFrame, item_id: str, block_words: int) -> tuple[DataFrame, int]:
    """The test items with text, and in how many blocks they are taken: about block_words words each, or one longer item."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col("`text`").alias("text")).where(F.col("text").isNotNull())
    size = items.select(F.sum(F.floor(F.length("text") / 2) + 1).alias("n")).first()["n"] or 0
    return items, max(1, -(-size // block_words))


def _found(texts: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """digest (of the text), spans, items and matches of the texts with a window of any block; a row a text."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/decontaminate-{uuid.uuid4().hex}"
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(f"{folder}/items")
    stored = spark.read.parquet(f"{folder}/items")
    for k in range(blocks):
        found = _scanned(texts, _test_set(stored.where(F.col("block") == k), window)).where(F.size("items") > 0)
        found.select(F.md5("text").alias("digest"), "spans", "items", "matches").dropDuplicates(["digest"]).write.mode("append").parquet(f"{folder}/found")
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")]
    return spark.read.parquet(f"{folder}/found").groupBy("digest").agg(*lists)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents (a column text) with n_words and, of the windows of test items that occur, spans, items and matches.

    spans are the runs of words that windows cover (start and length; those of several blocks may overlap), items the
    ids of the items, and matches the longest verbatim matches with their places in item and text, in words from 0.
    An item of fewer words than a window is matched as a whole.
    """
    items, blocks = _items(benchmark, item_id, block_words)
    if blocks == 1:
        return _scanned(documents, _test_set(items, window))
    found = _found(documents.select("text"), items, blocks, window)
    plain = [F.col(f"`{c}`") for c in documents.columns]
    counted = _scanned(documents, TestSet([], [], window)).select(*plain, "n_words").withColumn("digest__", F.md5("text"))
    return counted.join(found, F.col("digest__") == F.col("digest"), "left").select(*plain, "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in FOUND.items()))


def hit_words(spans: str = "spans") -> Column:
    """How many words the spans cover, each word once."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc, x):
        begin = F.greatest(acc["end"], x["a"])
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - begin)).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def report(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and longest_match (words; 0 without one)."""
    found = contamination(only(documents, "doc_id", "text"), only(benchmark, "item_id", "text"), window, block_words=block_words)
    items = F.array_sort(F.array_distinct(F.col("items")))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents without those that hold a window of a test item; the columns stay as they are."""
    columns = documents.columns
    named = documents.toDF(*(f"c{i}" for i in range(len(columns)))).withColumn("text", F.col(f"c{columns.index('text')}"))
    items, blocks = _items(only(benchmark, "item_id", "text"), "item_id", block_words)
    if blocks == 1:
        clean = _scanned(named, _test_set(items, window)).where(F.size("items") == 0)
    else:
        found = _found(named.select("text"), items, blocks, window).select("digest")
        clean = named.join(found, F.md5("text") == F.col("digest"), "left_anti")
    return clean.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
