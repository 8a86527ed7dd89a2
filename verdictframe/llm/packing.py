"""Conflict-constrained best-fit packing of texts into sequences of a fixed number of words.

A text longer than the capacity is cut into full pieces and a rest. Pieces are dealt by a hash of their id to shards
of about SHARD_WORDS words and SHARD_PIECES pieces (their number follows the size of the table), and each shard is
packed on its own, so that no task holds more than a bounded number of pieces. In a shard, pieces come largest first;
open bins are kept in the order of their residual room, and each carries a bitmap of its sources and one of its
duplicate clusters. The search starts at the tightest bin that has room and goes on to its successors until a bin is
found that is compatible: no piece of the same duplicate cluster (nor of the same text), and fewer pieces of the same
source than its limit. A set bit sends the search to the exact sets, so two values that share a bit don't keep pieces
apart. The bins that are closed to a source, or to a cluster of many pieces, are also kept in the order of their room,
and the search leaps over a run of them by bisection, so one source or cluster of any size doesn't make it walk.

The limit of a source is MOST_OF_A_SOURCE, or, where the shard has too few sources for that, twice the number of its
pieces that a bin takes on average if there are no more bins than the words need.

Only id, word count, source and cluster are moved; texts stay where they are. The words are those between ASCII
white space; the cluster is the hash of a text's words in lower case, which only copies share, unless a column says
otherwise. clustered() makes near copies (near_dedup) one cluster: a row has the component of its doc_id, and one
without an id that of its text.

Defined results: null texts, and texts without words, are in no bin. Repeated rows are repeated pieces (of one
cluster, so never in one bin). A null source or id is a value like any other. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, only
from verdictframe.llm.near_dedup import near_duplicates
from verdictframe.llm.text_kernel import SPACED, U64, mix, word_chunks

CAPACITY = 2048
MOST_OF_A_SOURCE = 4
SHARD_WORDS, SHARD_PIECES = 4_000_000, 100_000
BITS = 64
#: A cluster with more pieces in a shard has its bins listed.
LARGE_CLUSTER = 32
BIN = "shard int, bin int, used long, residual long, doc_ids array<long>, starts array<long>, lengths array<long>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, clusters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, words in word_chunks(batch.column(2), SPACED, lower=True):
            hashes = words.hashes()
            place = np.arange(len(hashes)) - words.first()[:-1][words.doc]
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes + place.astype(U64) * U64(0x9E3779B97F4A7C15)))])
            first = words.first()
            counts.append(words.counts)
            clusters.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(np.concatenate(counts)), pa.array(np.concatenate(clusters)), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n_words", "cluster", *batch.schema.names[3:]])


def measured(documents: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source (a hash), n_words and cluster of each row with words; a null of a cluster column means the text's hash."""
    rows = only(documents, "doc_id", "source", "text") if cluster is None else only(documents, "doc_id", "source", "text", cluster).toDF("doc_id", "source", "text", "given")
    plain = [F.col("doc_id").cast("long"), F.xxhash64("source").alias("source"), "text"]
    out = "doc_id long, source long, n_words long, cluster long"
    if cluster is None:
        return rows.select(*plain).mapInArrow(_measured, out).where("n_words > 0")
    given = F.when(F.col("given").isNotNull(), F.xxhash64("given")).alias("given")
    found = rows.select(*plain, given).mapInArrow(_measured, f"{out}, given long").where("n_words > 0")
    return found.select("doc_id", "source", "n_words", F.coalesce("given", "cluster").alias("cluster"))


def clustered(documents: DataFrame) -> DataFrame:
    """measured() with the near-duplicate component as cluster."""
    rows = cut(measured(documents))
    groups = near_duplicates(only(documents, "doc_id", "text")).where("doc_id is not null and n_shingles > 0")
    components = cut(groups.groupBy("doc_id").agg(F.xxhash64(F.min("component_id")).alias("component")))
    known = rows.where("doc_id is not null").join(components, "doc_id", "left").select("doc_id", "source", "n_words", "cluster", "component")
    without = rows.where("doc_id is null")
    wanted = known.join(without.select("cluster").distinct(), "cluster", "left_semi")
    by_text = wanted.groupBy("cluster").agg(F.min("component").alias("component"))
    unnamed = without.join(by_text, "cluster", "left").select("doc_id", "source", "n_words", "cluster", "component")
    return known.unionByName(unnamed).select("doc_id", "source", "n_words", F.coalesce("component", "cluster").alias("cluster"))


def first_open(order: list[tuple[int, int]], at: int, closed: list[tuple[int, int]]) -> int:
    """The first place of order from at on that isn't in closed, which is part of order; its length if there is none."""
    base = bisect_left(closed, order[at])
    if base == len(closed) or closed[base] != order[at]:
        return at
    lo, hi = at + 1, min(len(order), at + len(closed) - base)
    while lo < hi:
        middle = (lo + hi) // 2
        if middle - at + 1 > bisect_right(closed, order[middle]) - base:
            hi = middle
        else:
            lo = middle + 1
    return lo


def source_limits(pieces: list[tuple], capacity: int, most_of_a_source: int) -> dict[int, int]:
    """How many pieces of each source a bin may hold, for the sources that have more."""
    needed = max(1, -(-sum(p[0] for p in pieces) // capacity))
    limits = {source: max(most_of_a_source, -(-2 * n // needed)) for source, n in Counter(p[2] for p in pieces).items()}
    return {source: most for source, most in limits.items() if most < len(pieces)}


def best_fit(pieces: list[tuple], capacity: int, most_of_a_source: int) -> list[tuple[int, list[tuple]]]:
    """Bins as (room left, pieces); a piece is (n_words, cluster, source, doc_id, start)."""
    limits = source_limits(pieces, capacity, most_of_a_source)
    large = {c for c, n in Counter(p[1] for p in pieces).items() if n > LARGE_CLUSTER}
    order: list[tuple[int, int]] = []  # (room left, bin), the tightest first
    closed: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)  # parts of order, closed to a source or cluster
    closed_to: list[list[tuple[str, int]]] = []  # the same by bin
    members: list[list[tuple]] = []
    rooms: list[int] = []
    clusters: list[set] = []
    sources: list[dict] = []
    cluster_bits: list[int] = []
    source_bits: list[int] = []  # set when a source has as many pieces as it may
    for piece in sorted(pieces, key=lambda p: (-p[0], p[1], p[3] is None, p[3] or 0, p[4])):
        n, cluster, source = piece[0], piece[1], piece[2]
        cluster_bit, source_bit = 1 << (cluster % BITS), 1 << (source % BITS)
        at, chosen = bisect_left(order, (n, -1)), -1
        while at < len(order):
            b = order[at][1]
            if source_bits[b] & source_bit and sources[b].get(source, 0) >= limits.get(source, capacity + 1):
                at = first_open(order, at, closed["source", source])
            elif cluster_bits[b] & cluster_bit and cluster in clusters[b]:
                at = first_open(order, at, closed["cluster", cluster]) if cluster in large else at + 1
            else:
                chosen = b
                break
        if chosen < 0:
            chosen = len(members)
            members.append([])
            rooms.append(capacity)
            clusters.append(set())
            sources.append({})
            cluster_bits.append(0)
            source_bits.append(0)
            closed_to.append([])
        else:
            entry = order.pop(at)
            for key in closed_to[chosen]:
                closed[key].pop(bisect_left(closed[key], entry))
        members[chosen].append(piece)
        rooms[chosen] -= n
        clusters[chosen].add(cluster)
        cluster_bits[chosen] |= cluster_bit
        if cluster in large:
            closed_to[chosen].append(("cluster", cluster))
        count = sources[chosen][source] = sources[chosen].get(source, 0) + 1
        if count == limits.get(source, 0):
            source_bits[chosen] |= source_bit
            closed_to[chosen].append(("source", source))
        if rooms[chosen] > 0:
            entry = (rooms[chosen], chosen)
            insort(order, entry)
            for key in closed_to[chosen]:
                insort(closed[key], entry)
    return list(zip(rooms, members, strict=True))


def _packed(capacity: int, most_of_a_source: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard = None

        def bins() -> pa.RecordBatch:
            found = best_fit(held, capacity, most_of_a_source)
            lists = [pa.array([[p[k] for p in m] for _, m in found], pa.list_(pa.int64())) for k in (3, 4, 0)]
            rooms = np.array([r for r, _ in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard, np.int32)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(capacity - rooms), pa.array(rooms), *lists], names=["shard", "bin", "used", "residual", "doc_ids", "starts", "lengths"])

        for batch in batches:
            for key, *piece in zip(*(batch.column(k).to_pylist() for k in ("shard", "n_words", "cluster", "source", "doc_id", "start")), strict=True):
                if key != shard:
                    if held:
                        yield bins()
                    held, shard = [], key
                held.append(tuple(piece))
        if held:
            yield bins()

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, most_of_a_source: int = MOST_OF_A_SOURCE, shard_words: int = SHARD_WORDS, cluster: str | None = None) -> DataFrame:
    """A row a bin: shard, bin, used, residual, and of its pieces doc_ids, starts (first word) and lengths (words).

    cluster names a column of documents whose equal values may not share a bin.
    """
    return packed(measured(documents, cluster), capacity, most_of_a_source, shard_words)


def pack_apart(documents: DataFrame, capacity: int = CAPACITY, most_of_a_source: int = MOST_OF_A_SOURCE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """pack() with near copies kept apart."""
    return packed(clustered(documents), capacity, most_of_a_source, shard_words)


def packed(rows: DataFrame, capacity: int, most_of_a_source: int, shard_words: int) -> DataFrame:
    """The bins of measured rows."""
    rows = cut(rows)
    n_pieces = F.floor((F.col("n_words") - 1) / capacity) + 1
    total, pieces = (x or 0 for x in rows.agg(F.sum("n_words"), F.sum(n_pieces)).first())
    shards = max(1, -(-total // shard_words), -(-pieces // SHARD_PIECES))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1, F.lit(capacity).cast("long")))
    cuts = rows.select("doc_id", "source", "cluster", F.col("n_words").alias("all_words"), start.alias("start"))
    pieces = cuts.select(
        F.pmod(F.xxhash64("doc_id", "start", "cluster"), F.lit(shards)).cast("int").alias("shard"),
        F.least(F.lit(capacity).cast("long"), F.col("all_words") - F.col("start")).alias("n_words"),
        "cluster",
        "source",
        "doc_id",
        "start",
    )
    return pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(_packed(capacity, most_of_a_source), BIN)
