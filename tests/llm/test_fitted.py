"""The fitted operators against plain versions of their fits: weights, trees, counts; and the pipeline against brute force."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.test_text_operators import ALNUM, SCHEMA, SPACED, shingle_set, words
from verdictframe.llm import chat, quality_classifier, quality_rules
from verdictframe.llm.statistics import FEATURES, document_statistics


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        own = [rng.choice(["wort", "and", "the", "of", f"x{rng.randrange(400)}"]) for _ in range(rng.randrange(60, 200))]
        if not good:
            own = [w.upper() + "!!" if rng.random() < 0.3 else w for w in own] + ["spam", "$$$"] * rng.randrange(20)
        rows.append((i, " ".join(own) + ".", "en", "s", 0, int(good if rng.random() < 0.95 else not good)))
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int")


def test_classifier_equals_plain_normal_equations(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.fit(document_statistics(docs).select("doc_id", "features"), labels, quality_classifier.learned_fold())
    y = {r.doc_id: r.quality for r in labels.collect()}
    rows = {r.doc_id: np.array(r.features) for r in document_statistics(docs).collect()}
    folds = {r.doc_id: r.held for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality_classifier.CALIBRATE}) = 0 as held").collect()}
    learn = [d for d in sorted(rows) if crc32(str(d).encode()) % 5 != 0]
    solve, calibrate = [d for d in learn if not folds[d]], [d for d in learn if folds[d]]
    x, target = np.stack([rows[d] for d in solve]), np.array([y[d] for d in solve], float)
    scale = x.std(0)
    mean, scale = x.mean(0), np.where(scale > 1e-9, scale, 1)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    rng = np.random.default_rng(7)
    w, shift = rng.normal(0, 1 / quality_classifier.WIDTH, (len(FEATURES), quality_classifier.FEATURES_OUT)), rng.uniform(0, 2 * np.pi, quality_classifier.FEATURES_OUT)
    z = np.hstack([np.sqrt(2 / quality_classifier.FEATURES_OUT) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + shift), np.ones((len(x), 1))])
    # ridge regression as least squares over the rows and one row a penalty
    penalty = np.sqrt(np.append(np.full(quality_classifier.FEATURES_OUT, quality_classifier.RIDGE * len(x) / quality_classifier.FEATURES_OUT), 0) + 1e-9)
    weights = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(target, np.zeros(len(penalty))), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-4)
    # the shares of the bins over the calibrating rows, made monotone by the min-max formula
    bins = model.bins(np.stack([rows[d] for d in calibrate]))
    ones, n = (np.bincount(bins, weights=v, minlength=quality_classifier.BINS) for v in (np.array([y[d] for d in calibrate], float), np.ones(len(bins))))
    at = np.flatnonzero(n)
    plain = [max(min(ones[at[i : k + 1]].sum() / n[at[i : k + 1]].sum() for k in range(j, len(at))) for i in range(j + 1)) for j in range(len(at))]
    assert np.allclose(model.calibrated[at], plain)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, labels).collect()}
    some = sorted(rows)
    assert np.allclose([got[d] for d in some], model.scores(np.stack([rows[d] for d in some])), atol=1e-9)


def test_trees_equal_a_walk_and_their_splits_an_exhaustive_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5) ^ (rng.random(300) < 0.05)).astype(float)
    forest = quality_rules.grow(x, y, np.array([0, 0, 1, -1]), trees=5, depth=3)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.margins(x), [walk(row) for row in x])
    one = quality_rules.grow(x, y, np.zeros(4, int), trees=1, depth=1)
    p = 1 / (1 + np.exp(-one.start))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        if min(left.sum(), (~left).sum()) < quality_rules.LEAST:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality_rules.HISTOGRAM + 1)[1:-1])) for j in range(4)]
    best = max(gain(j, t) for j in range(4) for t in edges[j])
    root = int(one.roots[0])
    assert gain(int(one.feature[root]), float(one.threshold[root])) == pytest.approx(best)
    left = x[:, one.feature[root]] <= one.threshold[root]
    for child, side in ((one.left[root], left), (one.right[root], ~left)):
        assert one.value[child] == pytest.approx(-quality_rules.RATE * g[side].sum() / (h[side].sum() + 1))


def test_chat_model_counts_equal_plain_counts():
    rng = np.random.default_rng(5)
    states, features = rng.integers(0, chat.STATES, 50), np.stack([rng.integers(0, w, 50) for w in chat.WIDTHS], axis=1)
    counts = chat._counts(states, features, True)
    plain = Counter([("start", states[0])] + [("step", a, b) for a, b in zip(states, states[1:], strict=False)] + [(k, s, f) for row, s in zip(features, states, strict=True) for k, f in enumerate(row)])
    want = [plain["start", s] for s in range(chat.STATES)] + [plain["step", a, b] for a in range(chat.STATES) for b in range(chat.STATES)]
    want += [plain[k, s, f] for k, w in enumerate(chat.WIDTHS) for s in range(chat.STATES) for f in range(w)]
    assert counts.tolist() == want
    model = chat.model_of(counts)
    row = np.array([plain["step", 0, b] + 1 for b in range(chat.STATES)], float)
    assert np.allclose(np.exp(model.transition[0]), row / row.sum())


def near(a, b):
    return a and b and 100 * len(a & b) >= 75 * len(a | b)


def test_pipeline_equals_brute_force(spark, sf):
    """The verdicts of the two fitted stages as given; everything behind them by trying all pairs, windows and bins."""
    import corpus_pipeline as pipeline

    docs, labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    accepted = {r.doc_id for r in quality_classifier.score(docs, labels).where("predicted = 1").collect()}
    kept = sorted(accepted & {r.doc_id for r in quality_rules.verdicts(docs, labels).where("kept").collect()})
    sets, root = {d: shingle_set(texts[d]) for d in kept}, {d: d for d in kept}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if near(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [d for d in kept if find(d) == d]
    windows = {tuple(w[i : i + 10]) for r in benchmark.collect() for w in [words(ALNUM, r.text)] for i in range(max(1, len(w) - 9)) if w}

    def dirty(text):
        w = words(ALNUM, text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    kept = [d for d in kept if not dirty(texts[d])]
    bins = pipeline.run(spark, sf).collect()
    held = Counter()
    for b in bins:
        for doc, length in zip(b.doc_ids, b.lengths, strict=True):
            held[doc] += length
    assert held == {d: len(words(SPACED, texts[d])) for d in kept}


def test_pipeline_of_repeated_rows_and_of_nothing(spark, sf, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (tmp_path / "twice").mkdir()
    (tmp_path / "none").mkdir()
    docs.union(docs.limit(60)).write.parquet(f"{tmp_path}/twice/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        for folder in ("twice", "none"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    pieces = lambda path: Counter((d, s) for b in pipeline.run(spark, path).collect() for d, s in zip(b.doc_ids, b.starts, strict=True))
    twice = pieces(f"{tmp_path}/twice")
    assert twice and max(twice.values()) == 1  # a repeated row is packed once
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
