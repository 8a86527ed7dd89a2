"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes) and a SuperMinHash signature: every
   element walks its own permutation of the slots, one slot a round, and offers round + random rank there. Rounds run
   over all elements of a text together; a slot that is filled in an early round can't be improved by a later one, so
   a text stops as soon as its slots are full (the early stop of the method).
2. Texts with equal sets are collapsed to one representative. The slots of a signature are cut into bands; a band
   that two representatives share puts them into one bucket, as a row a member, never as pairs.
3. Each member of a bucket is held against a pivot (the smallest document of all its buckets) on full sets. Verified
   links alone are united; a group of copies, however large, is mostly one component after this linear pass.
4. Buckets whose members are now of several components are searched by signatures, across components only; pairs whose
   signatures agree form candidate groups. So texts that share a band by chance, or some boilerplate, never make up a
   group. Boilerplate puts a share of all texts that hold it into one bucket, which must not be searched pair by
   pair: members of buckets of more than HOT_BUCKET documents meet by their rarest shingles instead, of which a link
   shares at least one. What they have in common is not rare among them, so those that only share a template don't meet.
5. Each candidate group is verified on full sets, again across its components: those of its largest component meet
   the others, in pairs of bounded blocks, but not each other.
6. Distributed union-find over the verified links gives the groups.

Approximations: with 48 bands of 5 slots a pair of similarity 0.75 is in no common bucket with a probability of 2e-6;
in steps 3 to 5 a pair is passed over when its signatures agree in fewer slots than SLACK standard deviations below the
threshold (5: 3e-7 of the pairs at the threshold). slack=None counts every pair of a bucket on full sets.
Every link that is used is confirmed on full sets.

Costs: a whole text is shuffled only if its document is held against another one (texts of others are filtered out by a
bitmap of fixed size before the join; with far more such documents than bits they pass it). Members of a hot bucket
that share 61 to 75 % beyond what is rare still meet in all pairs of blocks.

Hot groups: members meet their bucket by an equi-join whose bucket side has a row a bucket (summed before the
shuffle), which Spark's adaptive skew join splits; blocks bound what a task holds.

Defined results: a null or empty text has no shingles and is a group of its own, kept. Rows with the same doc_id are
the same document, also when their texts differ: links of each text are links of the document. A row with a null
doc_id takes the group of its text, if others have it, and is kept only when it has none (deduplicate() tells such rows
apart by their texts). Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, held_by, only, summed
from verdictframe.llm.components import components
from verdictframe.llm.text_kernel import SPACED, U64, distinct, mix, shingles, word_chunks

WORDS = 5
THRESHOLD = 75
BANDS, ROWS = 48, 5
SLOTS = BANDS * ROWS
#: A block of full sets has about so many documents and shingles at most; a block of signatures so many documents.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_SIGNATURES = 128, 1_000_000, 1024
#: Texts are sketched in chunks of so many bytes: a shingle's walk takes SLOTS bytes, so the walks of a chunk about 6 MB.
SKETCHED_BYTES = 1 << 17
SLACK = 5.0

SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("signature", pa.binary())])


def superminhash(values: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (uint8, a row a set) of sets whose elements stand one after another; an empty set has all ones."""
    n = len(counts)
    best = np.full(n * slots, np.iinfo(np.uint64).max, U64)
    filled = np.zeros(n * slots, bool)
    owner = np.repeat(np.arange(n), counts)
    walk = pick = None
    for step in range(slots):
        if step:
            go = (filled.reshape(n, slots).sum(1) < slots)[owner]
            if not go.any():
                break
            values, owner = values[go], owner[go]
            if walk is None:  # the permutations, with the swap of the first round
                walk = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
                walk[np.arange(len(values)), pick[go]] = 0
                walk[:, 0] = pick[go]
            elif not go.all():
                walk = walk[go]
        rank = mix(values + U64((step + 1) * 0xD1B54A32D192ED03 % 2**64))
        pick = step + ((rank >> U64(32)) % U64(slots - step)).astype(np.int64)
        if walk is None:
            slot = pick
        else:
            rows = np.arange(len(values))
            slot = walk[rows, pick].astype(np.int64)
            walk[rows, pick] = walk[:, step]
            walk[:, step] = slot
        at = owner * slots + slot
        new = ~filled[at]
        at = at[new]
        np.minimum.at(best, at, mix(rank[new]))
        filled[at] = True
    return (best & U64(0xFF)).astype(np.uint8).reshape(n, slots)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts, the index of its first text, the texts' shingle sets and the sizes of these."""
    for lo, words in word_chunks(column, SPACED, lower=True, limit=SKETCHED_BYTES):
        yield lo, *distinct(*shingles(words.hashes(), words, WORDS), words.n_docs)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
    stop = np.cumsum(counts)
    return (total[stop] - total[stop - counts]).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for _, values, counts in _sets(batch.column(1)):
            signature = superminhash(values, counts)
            parts.append((counts, _sums(mix(values), counts), _sums(mix(values ^ U64(0x5851F42D4C957F2D)), counts), signature))
        if parts:
            counts, key1, key2, signature = (np.concatenate(x) for x in zip(*parts, strict=True))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), len(signature), [None, pa.py_buffer(signature.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(key1), pa.array(key2), flat.cast(pa.binary())], schema=SKETCH)


_MEMBER = [("root", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int64()), ("wide", pa.bool_()), ("signature", pa.binary()), ("shingles", pa.binary())]
MEMBER = "root long, lo int, hi int, doc_id long, label long, wide boolean, signature binary, shingles binary"
LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def block_pairs(wide: bool, block: int, narrow_blocks: int, wide_blocks: int) -> list[tuple[int, int]]:
    """The pairs of blocks in which a member stands: narrow blocks meet each other and the wide ones, which don't meet."""
    if wide:
        return [(k, narrow_blocks + block) for k in range(narrow_blocks)]
    own = [(block, block)] if narrow_blocks == 1 and not wide_blocks else [(min(block, k), max(block, k)) for k in range(narrow_blocks) if k != block]
    return own + [(block, narrow_blocks + k) for k in range(wide_blocks)]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of members, once for each pair of blocks in which a member stands."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _MEMBER, strict=True)], names=[n for n, _ in _MEMBER])

    for batch in batches:
        rows: list[tuple] = []
        fields = [batch.column(k).to_pylist() for k in ("doc_id", "key1", "root", "label", "wide", "block", "narrow_blocks", "wide_blocks", "signature")]
        for lo, values, counts in _sets(batch.column("text")):
            keys = _sums(mix(values), counts)
            stop = np.cumsum(counts)
            for i, (a, b) in enumerate(zip(stop - counts, stop, strict=True)):
                doc_id, key1, root, label, wide, block, narrow_blocks, wide_blocks, signature = (f[lo + i] for f in fields)
                if key1 != keys[i]:  # another text of the same doc_id
                    continue
                full = values[a:b].tobytes()
                for x, y in block_pairs(wide, block, narrow_blocks, wide_blocks):
                    rows.append((root, x, y, doc_id, label, wide, signature, full))
                    if len(rows) >= 64:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def alike(size: np.ndarray, signatures: np.ndarray, wide: np.ndarray, label: np.ndarray, threshold: int, slack: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels, not both wide, which sizes and signatures don't rule out, and how many slots agree.

    Sets come in the order of their sizes.
    """
    t = threshold / 100
    enough = -1 if slack is None else SLOTS * t - slack * (SLOTS * t * (1 - t)) ** 0.5
    left, right, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, high = np.searchsorted(size, -(-size * threshold // 100), side="left"), np.searchsorted(size, size * 100 // threshold, side="right")
    for i in np.flatnonzero(~wide):
        j = np.arange(low[i], high[i])
        j = j[(label[j] != label[i]) & (wide[j] | (j > i))]
        if not len(j):
            continue
        agree = (signatures[j] == signatures[i]).sum(1)
        ok = agree >= enough
        left.append(np.full(int(ok.sum()), i))
        right.append(j[ok])
        same.append(agree[ok])
    return np.concatenate(left), np.concatenate(right), np.concatenate(same)


def verified(ids: np.ndarray, label: np.ndarray, wide: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], threshold: int = THRESHOLD, slack: float | None = SLACK) -> list[tuple[int, int]]:
    """Links of a pair of blocks: pairs with 100 * shared >= threshold * together, as many as unite the labels.

    Pairs that are already united (by equal labels or by links of the block) are not counted again.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    ids, label, wide, signatures, size, sets = ids[order], label[order], wide[order], signatures[order], size[order], [sets[i] for i in order]
    left, right, same = alike(size, signatures, wide, label, threshold, slack)
    labels, of = np.unique(label, return_inverse=True)
    union, out = _Union(len(labels)), []
    for k in np.argsort(-same, kind="stable"):
        i, j = int(left[k]), int(right[k])
        if ids[i] == ids[j] or union.find(of[i]) == union.find(of[j]):
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
            union.join(of[i], of[j])
            out.append((int(ids[i]), int(ids[j])))
    return out


def _groups(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """Links of the rows of each key (the first three columns), whose rows come one key after another."""
    held: list[tuple] = []
    key, out = None, []

    def found() -> list[tuple[int, int]]:
        return links(*zip(*held, strict=True)) if len(held) > 1 else []

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=LINK)

    for batch in batches:
        for a, b, c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (a, b, c) != key:
                out += found()
                held, key = [], (a, b, c)
            held.append(row)
        if out:
            yield batch_of(out)
            out = []
    if out := found():
        yield batch_of(out)


def _bytes(rows: tuple) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in rows])


def _verify(slack: float | None):
    def links(ids, label, wide, signatures, sets):
        return verified(np.array(ids), np.array(label), np.array(wide), _bytes(signatures), [np.frombuffer(x, U64) for x in sets], slack=slack)

    return lambda batches: _groups(batches, links)


def _estimate(slack: float | None):
    """Pairs whose signatures agree, as many as unite what they tie together."""

    def links(ids, label, wide, size, signatures):
        size = np.array(size)
        order = np.argsort(size, kind="stable")
        ids = np.array(ids)[order]
        left, right, _ = alike(size[order], _bytes(signatures)[order], np.array(wide)[order], np.array(label)[order], THRESHOLD, slack)
        union = _Union(len(ids))
        return [(int(ids[i]), int(ids[j])) for i, j in zip(left.tolist(), right.tolist(), strict=True) if union.join(i, j)]

    return lambda batches: _groups(batches, links)


def buckets(sets: DataFrame) -> DataFrame:
    """band, doc_id and first (the smallest doc_id of the bucket) of all members of buckets with several documents."""
    bands = sets.select("doc_id", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {ROWS} + 1, {ROWS})))")).alias("band"))
    several = bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("band", "first")
    return bands.join(several, "band")


def _blocks(n: Column, n_shingles: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK_DOCS, n_shingles / BLOCK_SHINGLES)).cast("int")


def verified_links(texts: DataFrame, sets: DataFrame, members: DataFrame, slack: float | None) -> DataFrame:
    """u, v: links on full sets inside groups of members (root, doc_id, label, wide), across labels, not between wide ones."""
    known = members.join(sets.select("doc_id", "key1", "signature", "n_shingles"), "doc_id")
    n, shingles = F.count_if("wide"), F.sum(F.when(F.col("wide"), F.col("n_shingles")).otherwise(0))
    sizes = known.groupBy("root").agg(_blocks(n, shingles).alias("wide_blocks"), _blocks(F.count(F.lit(1)) - n, F.sum("n_shingles") - shingles).alias("narrow_blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("wide"), F.col("wide_blocks")).otherwise(F.col("narrow_blocks"))).cast("int").alias("block")
    placed = cut(known.join(sizes, "root").select("doc_id", "key1", "signature", "root", "label", "wide", "narrow_blocks", "wide_blocks", block))
    full = held_by(texts, placed, "doc_id").join(placed, "doc_id").mapInArrow(_members, MEMBER)
    return full.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_verify(slack), "u long, v long")


def _with_largest(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys with several labels, and per key: the largest label, its size, the number of the others."""
    each = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).where("labels > 1")
    return rows.join(mixed.select(key, F.col("top.label").alias("largest"), F.col("top.n").alias("n_wide"), (F.col("all") - F.col("top.n")).alias("n_narrow")), key).withColumn("wide", F.col("label") == F.col("largest"))


def ties(rows: DataFrame, sets: DataFrame, slack: float | None) -> DataFrame:
    """u, v: documents of one key (rows: key, doc_id, label) and different labels whose signatures agree, by pairs of blocks."""
    mixed = _with_largest(rows, "key")
    blocks = {c: F.ceil(F.col(f"n_{c}") / BLOCK_SIGNATURES).cast("int") for c in ("wide", "narrow")}
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("wide"), F.col("wide_blocks")).otherwise(F.col("narrow_blocks"))).cast("int")
    sized = mixed.select("key", "doc_id", "label", "wide", *(c.alias(f"{n}_blocks") for n, c in blocks.items())).withColumn("block", block)
    # as block_pairs()
    pair = "named_struct('lo', {}, 'hi', {})"
    across = f"transform(sequence(0, narrow_blocks - 1), k -> {pair.format('k', 'narrow_blocks + block')})"
    own = f"transform(filter(sequence(0, narrow_blocks - 1), k -> k <> block), k -> {pair.format('least(block, k)', 'greatest(block, k)')})"
    to_wide = f"transform(sequence(0, wide_blocks - 1), k -> {pair.format('block', 'narrow_blocks + k')})"
    places = F.when(F.col("wide"), F.expr(across)).otherwise(F.concat(F.expr(own), F.expr(to_wide)))
    found = sized.select("key", "doc_id", "label", "wide", F.explode(places).alias("p")).join(sets.select("doc_id", F.col("n_shingles").alias("size"), "signature"), "doc_id")
    keyed = found.select("key", "p.lo", "p.hi", "doc_id", "label", "wide", "size", "signature")
    return keyed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_estimate(slack), "u long, v long")


#: Counters by which shingles are put in order, and buckets with more documents than this are searched by rare shingles.
COUNTERS, HOT_BUCKET = 1 << 18, 1024


def _own_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The place and the set of each text of a batch (columns text, key1, ...), unless another text of its id was meant."""
    key1 = batch.column("key1").to_numpy()
    for lo, values, counts in _sets(batch.column("text")):
        keys, stop = _sums(mix(values), counts), np.cumsum(counts)
        for i in np.flatnonzero(keys == key1[lo : lo + len(counts)]):
            yield lo + int(i), values[stop[i] - counts[i] : stop[i]]


def _counters(values: np.ndarray) -> np.ndarray:
    return (values & U64(COUNTERS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS)
    for batch in batches:
        for _, values, _ in _sets(batch.column("text")):
            total += np.bincount(_counters(values), minlength=COUNTERS)
    yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])


def rare_postings(texts: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """key (a shingle), doc_id, label: the rarest shingles of members (doc_id, label), as many as a link must share one of.

    Two sets with a similarity of t share at least t n shingles of the larger one's n; so whatever the order of all
    shingles, they share one of the first n - tn + 1 of each. The order is by how often a shingle's counter was hit, then
    by the shingle, so what many members have in common comes last. No link is lost.
    """
    known = cut(members.join(sets.select("doc_id", "key1"), "doc_id"))
    held = cut(held_by(texts, known, "doc_id").join(known, "doc_id").select("doc_id", "label", "key1", "text"))
    often = summed(held.mapInArrow(_counted, "k string, v binary"), "k", "v").get("all", np.zeros(COUNTERS))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
            for i, values in _own_sets(batch):
                n = len(values)
                prefix = values[np.lexsort((values, often[_counters(values)]))[: n + (-n * THRESHOLD // 100) + 1]]
                place.append(np.full(len(prefix), i))
                keys.append(prefix)
            rows = pa.array(np.concatenate(place))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc_id").take(rows), batch.column("label").take(rows)], names=["key", "doc_id", "label"])

    every = held.mapInArrow(first, "key long, doc_id long, label long")
    several = every.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return every.join(several, "key", "left_semi")


def candidate_groups(tied: DataFrame, sets: DataFrame, united: DataFrame, slack: float | None, texts: DataFrame) -> DataFrame:
    """root, doc_id, label and wide of the members of candidate groups: documents of several components that look alike.

    tied is as of buckets(), united has node and root of the components so far; label is a member's component, and
    wide are the members of the group's largest one. Buckets of more than HOT_BUCKET documents aren't searched
    themselves: their members meet by rare shingles instead.
    """
    labelled = cut(tied.join(united.withColumnRenamed("root", "label"), F.col("doc_id") == F.col("node"), "left").select(F.col("band").alias("key"), "doc_id", F.coalesce("label", "doc_id").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    hot = cut(labelled.join(mixed.where(F.col("n") > HOT_BUCKET).select("key"), "key", "left_semi").select("doc_id", "label").distinct())
    found = ties(labelled.join(mixed.where(F.col("n") <= HOT_BUCKET).select("key"), "key", "left_semi"), sets, slack)
    if not hot.isEmpty():
        found = found.union(ties(rare_postings(texts, hot, sets), sets, slack))
    groups = components(found)
    nodes = groups.select(F.col("node").alias("doc_id"), "root").union(groups.select(F.col("root").alias("doc_id"), "root").distinct())
    named = nodes.join(united.select("node", F.col("root").alias("label")), F.col("doc_id") == F.col("node"), "left").select("root", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    return _with_largest(named, "root").select("root", "doc_id", "label", "wide")


def near_duplicates(documents: DataFrame, slack: float | None = SLACK) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and kept."""
    texts = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = cut(texts.mapInArrow(_sketches, "doc_id long, n_shingles long, key1 long, key2 long, signature binary"))
    keys = ["n_shingles", "key1", "key2"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    sets = cut(full.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature")))

    # rows of one doc_id with several texts tie these texts together
    several = full.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b")).where("a <> b").select("doc_id")
    of_id = full.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), *keys).join(sets.select(F.col("doc_id").alias("v"), *keys), keys).select("u", "v")

    tied = cut(buckets(sets.select("doc_id", "signature")))
    pivots = cut(tied.groupBy("doc_id").agg(F.min("first").alias("root")).where("root < doc_id"))
    stars = pivots.select("root", "doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("wide"))
    stars = stars.union(pivots.select("root").distinct().select("root", F.col("root").alias("doc_id"), F.col("root").alias("label"), F.lit(False).alias("wide")))
    first = cut(verified_links(texts, sets, stars, slack).union(of_id))
    united = components(first)
    further = verified_links(texts, sets, candidate_groups(tied, sets, united, slack, texts), slack)
    groups = components(united.select(F.col("node").alias("u"), F.col("root").alias("v")).union(further))

    labelled = sets.join(groups, F.col("doc_id") == F.col("node"), "left").select(*keys, F.coalesce("root", "doc_id").alias("component_id"))
    return rows.join(labelled, keys, "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"),
    )


#: Rows without an id get one from their text here, beyond all others.
NO_ID = 1 << 62


def deduplicate(documents: DataFrame) -> DataFrame:
    """documents without those that aren't the first of their group; the columns stay as they are.

    Of rows that repeat a text with its doc_id one stays. Rows without an id are known by their text: they come after
    all that have one, and of equal ones a single row stays. Only rows whose id stands more than once are shuffled as a whole.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 60)))
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = F.col(names[documents.columns.index("text")])
    plain = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names, strict=True)), own.alias("own"))
    found = cut(near_duplicates(plain.select(F.col("own").alias("doc_id"), text.alias("text"))).select("doc_id", "kept"))
    removed = found.where("not kept").select(F.col("doc_id").alias("removed")).distinct()
    repeated = cut(found.where("kept").groupBy(F.col("doc_id").alias("repeated")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repeated"))
    kept = plain.join(removed, F.col("own") == F.col("removed"), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, F.col("own") == F.col("repeated"), "left_anti")
        again = kept.join(repeated, F.col("own") == F.col("repeated"), "left_semi").withColumn("digest", F.md5(text)).dropDuplicates(["own", "digest"]).drop("digest")
        kept = once.unionByName(again)
    return kept.select(*(F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)))
