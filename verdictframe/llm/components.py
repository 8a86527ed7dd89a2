"""Connected components of a graph of any size: union-find inside the tasks, stars between them.

The links of a task are first joined by union-find, which leaves at most one link for each node of the task. A graph
of which no more than LINKS_AT_ONCE links are left (16 bytes each) is finished by one more union-find. A larger one is
turned towards its smallest nodes, round after round, by a large-star and a small-star step (shuffles on the nodes,
with map-side minima) until nothing moves; the number of rounds grows with the logarithm of the longest chain. Nothing
but one count and one checksum a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: So many links are joined at once; more links of a task make further forests.
LINKS_AT_ONCE = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (u, v): each node that isn't the smallest of its component, with the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = parent != np.arange(len(nodes))
    return nodes[child], nodes[parent[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined():
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=EDGE)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= LINKS_AT_ONCE:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """node and root, the smallest node of its component, of all nodes that aren't roots themselves.

    links has columns u and v (long). Links of a node with itself, repeated links and links either way round are
    fine; links with a null are ignored. Without links the result is empty.
    """
    edges = cut(links.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forests, "u long, v long"))
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] <= at_once:
            edges = cut(edges.coalesce(1).mapInArrow(_forests, "u long, v long"))
        if now["n"] <= at_once or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = cut(_small_star(_large_star(edges)))
        before = now
