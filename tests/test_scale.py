"""Operators that deal a group over many tasks, against their plain definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictframe.operators import comparison, retrieval, splits


def test_group_ordinal_numbers_a_stratum_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randrange(10**6), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, o long, k long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        placed = splits.group_ordinal(df, ["g"], "o", "k").withColumn("task", F.spark_partition_id())
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((o, k) for x, o, k in rows if x == g)
        want |= {k: (i, len(own)) for i, (_, k) in enumerate(own)}
    assert {r.k: (r.place, r.size) for r in got} == want
    assert len({r.task for r in got if r.g == "a"}) >= 6


def test_group_limits_are_taken_before_the_shuffle(spark, monkeypatch):
    rows = [(k % 3, (k * 37) % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, k int").repartition(5)
    want = sorted((g, k, i + 1) for g in range(3) for i, (_, k) in enumerate(sorted(((-o, k) for x, o, k in rows if x == g))[:7]))
    limited = splits.limit_per_group(df, ["g"], 7, F.desc("o"), "k")
    assert "WindowGroupLimit" in limited._jdf.queryExecution().toString()
    assert sorted((r.g, r.k, r.place) for r in limited.collect()) == want
    monkeypatch.setattr(splits, "GROUP_LIMIT", 3)
    assert sorted((r.g, r.k, r.place) for r in splits.limit_per_group(df, ["g"], 7, F.desc("o"), "k").collect()) == want


def test_stream_sums_repeat_the_plain_generator():
    for n, seed in ((2, 1), (7, 42), (64, 3), (1000, 9)):
        values = np.random.default_rng(n).normal(size=n)
        draw = random.Random(seed).randrange
        plain = [math.fsum(values[[draw(n) for _ in range(n)]]) for _ in range(50)]
        assert np.allclose(comparison.stream_sums(values, 50, seed), plain, atol=1e-9)


def test_binomial_splits_are_multinomial_draws():
    sizes = np.array([100, 100, 100, 30])
    counts = np.stack([comparison.block_counts(sizes, b, 4000, 5) for b in range(4)])
    assert (counts.sum(0) == 330).all()
    share = sizes / 330
    assert np.allclose(counts.mean(1), 330 * share, rtol=0.02)
    covariance = 330 * (np.diag(share) - np.outer(share, share))
    assert np.abs(np.cov(counts) - covariance).max() < 6


def test_bootstrap_over_blocks_agrees_with_the_plain_one(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, f"{k:05d}", rng.random(), rng.random() + shift) for g, shift, n in (("a", 0.02, 1500), ("b", 0.0, 900), ("small", 0.3, 12)) for k in range(n)]
    pairs = spark.createDataFrame(rows, "g string, sample_id string, baseline double, candidate double").repartition(5)
    plain = {r.g: r for r in comparison.paired_bootstrap(pairs, ["g"], 2000).collect()}
    monkeypatch.setattr(comparison, "BLOCK_PAIRS", 100)
    blocks = {r.g: r for r in comparison.paired_bootstrap(pairs, ["g"], 2000).collect()}
    again = {r.g: r for r in comparison.paired_bootstrap(pairs.repartition(3), ["g"], 2000).collect()}
    assert blocks == again and blocks["small"] == plain["small"]
    for g, p in plain.items():
        b = blocks[g]
        assert (b.n, b.delta) == (p.n, pytest.approx(p.delta))
        width = p.ci_high - p.ci_low
        assert abs(b.ci_low - p.ci_low) < 0.08 * width and abs(b.ci_high - p.ci_high) < 0.08 * width
        assert abs(b.p_value - p.p_value) < 0.05


def vectors_of(spark, n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + 0.6 * rng.normal(size=(n, dim))
    x[5] = x[9] = x[14]
    x[20] = 0
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, x[0].tolist()), (n, None)], "vec_id long, embedding array<double>").repartition(5)


def plain_nearest(x, queries, k):
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    out = {}
    for q in queries:
        s = unit @ unit[q]
        rounded = np.sign(s) * np.floor(np.abs(s) * 1e6 + 0.5)
        out[q] = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-rounded[i], i))[:k]
    return out


def ranks(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.item)
    return out


@pytest.mark.parametrize("blocks", [(4096, 1024), (50, 7)])
def test_nearest_in_blocks_equals_plain_ranks(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", blocks[0])
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", blocks[1])
    x, df = vectors_of(spark)
    queries = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    want = plain_nearest(x, range(0, 700, 20), 10)
    assert ranks(retrieval.nearest(df, queries, 10)) == want
    index = retrieval.CellIndex(df)
    assert ranks(index.search(queries, 10, probes=2, exact=True)) == want
    got = ranks(index.search(queries, 10))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9
    assert index.probes() < len(index.centres)


def test_index_recall_on_the_table(spark, sf):
    from verdictframe.plans import ranking, registry

    vectors = registry.table(spark, sf, "embeddings")
    full = {(r.query_id, r.item) for r in retrieval.nearest(vectors, ranking.queries_of(vectors), ranking.K).collect()}
    got = {(r.query_id, r.item) for r in ranking.ret01_nearest_by_cells(spark, sf).collect()}
    assert len(got & full) >= 0.9 * len(full)


def test_index_of_few_and_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    queries = none.selectExpr("vec_id as query_id", "embedding as query")
    assert retrieval.nearest(none, queries, 3).count() == 0 and retrieval.CellIndex(none).search(queries, 3, exact=True).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = retrieval.CellIndex(two).search(two.selectExpr("vec_id as query_id", "embedding as query"), 5, exact=True)
    assert ranks(found) == {1: [2], 2: [1]}
