"""The operators on texts against plain Python, on texts that are null, empty, long, repeated and odd."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictframe.llm import chat, cluster, decontaminate, language, license_scan, near_dedup, packing, quality_classifier, quality_rules
from verdictframe.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "É ß x", "one two three", "x\x1fy\x0bz", "LICENSE license " * 30, "a b c d e " * 400, "ä" * 5000, "😀 " * 7]


def words(pattern, text, lower=True):
    return pattern.findall((text or "").translate(LOWER) if lower else text or "")


def corpus(spark, seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "license", "Größe", "été"]
    texts = list(ODD)
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 150))]
        texts.append(" ".join(base) + ".")
        for rate in (0.01, 0.03, 0.06, 0.3):
            if rng.random() < 0.5:
                texts.append(" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) + ".")
        if rng.random() < 0.3:
            texts.append(texts[-1])
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return corpus(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clashing(df):
    """The same table with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("root", "node", "score", "words", "n_words", "labelled", "matches", "cluster", "signature", "features", "item_id", "u", "v", "quality")
    return df.select("*", *(F.lit(1).alias(n) for n in names))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = words(SPACED, text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    sets = {d: shingle_set(text) for d, text, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs, rows):
    want = groups(rows)
    got = near_dedup.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_deduplicate_keeps_columns_and_first_of_each_group(docs, rows):
    want = groups(rows)
    kept = near_dedup.deduplicate(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, root) in want.items() if d == root}


@pytest.mark.parametrize("slack", [near_dedup.SLACK, None])
def test_large_groups_are_verified_in_blocks(spark, docs, rows, monkeypatch, slack):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SIGNATURES", 2)
    want = groups(rows)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, slack).collect()} == {(d, root) for d, (_, root) in want.items()}


def test_deduplicate_keeps_one_of_repeated_rows_and_of_copies_without_id(spark):
    same, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, same), (1, same), (2, same), (None, same), (None, same), (None, other), (None, other), (5, None), (5, None), (6, ""), (None, None), (None, None), (7, other + " x y z " + same)]
    kept = near_dedup.deduplicate(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, own int")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, same), (None, other), (5, None), (6, ""), (None, None), (7, other + " x y z " + same)])
    unique = spark.createDataFrame([(1, same), (2, same), (3, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.deduplicate(unique).collect()) == [1, 3]


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (8, b + " more"), (20, c), (20, c + " x y"), (21, None), (21, c)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (8, 3), (20, 20), (21, 20), (21, 21)}  # the null text is on its own


def edits(rng, base, n, vocabulary=10_000):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(vocabulary)}"
    return out


def test_boilerplate_makes_no_candidate_group(spark):
    """Texts that share a third of their shingles and no more, and chains of edits between real groups."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(70)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(70)])) for i in range(150)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(40):
        rows.append((1000 + i, " ".join(chain)))
        chain = edits(rng, chain, 2)
    base = [f"b{i}" for i in range(100)]
    rows += [(2000 + i, " ".join(edits(rng, base, rng.randrange(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = groups(rows)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == {(d, root) for d, (_, root) in want.items()}
    sets = near_dedup.cut(docs.mapInArrow(near_dedup._sketches, "doc_id long, n_shingles long, key1 long, key2 long, signature binary")).where("doc_id < 1000")
    tied = near_dedup.buckets(sets)
    assert tied.select("doc_id").distinct().count() > 100
    nothing = spark.createDataFrame([], "node long, root long")
    assert near_dedup.candidate_groups(tied, sets, nothing, near_dedup.SLACK, docs).count() == 0


@pytest.mark.parametrize("n", [200, 800])
def test_members_of_hot_buckets_meet_by_rare_shingles(spark, monkeypatch, n):
    """Texts that share a template fill buckets; nothing of them is compared, and real links among them are found."""
    rng = random.Random(n)
    template = [f"t{i}" for i in range(70)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(70)])) for i in range(n)]
    base = [f"b{i}" for i in range(100)]
    rows += [(5000 + i, " ".join(template + edits(rng, base, rng.randrange(0, 5)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 20)
    want = groups(rows) if n <= 200 else None
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(d, root) for d, (_, root) in want.items()} if want else len({c for _, c in got}) >= n + 1
    sets = near_dedup.cut(docs.mapInArrow(near_dedup._sketches, "doc_id long, n_shingles long, key1 long, key2 long, signature binary"))
    members = near_dedup.buckets(sets).groupBy("band").count()
    assert members.agg({"count": "max"}).first()[0] > n / 10  # the template makes a hot bucket
    unlike = sets.where("doc_id < 5000").selectExpr("doc_id", "doc_id as label")
    assert near_dedup.rare_postings(docs, unlike, sets).count() == 0


def test_rare_shingles_lose_no_link(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 1)
    want = groups(rows)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == {(d, root) for d, (_, root) in want.items()}
    sets = near_dedup.cut(docs.mapInArrow(near_dedup._sketches, "doc_id long, n_shingles long, key1 long, key2 long, signature binary").where("n_shingles > 0").dropDuplicates(["doc_id"]))
    postings = near_dedup.rare_postings(docs, sets.selectExpr("doc_id", "doc_id as label"), sets).collect()
    keys = {}
    for r in postings:
        keys.setdefault(r.doc_id, set()).add(r.key)
    full = {d: shingle_set(t) for d, t, *_ in rows}
    for a in full:
        for b in full:
            if a < b and full[a] and full[b] and 100 * len(full[a] & full[b]) >= 75 * len(full[a] | full[b]):
                assert keys[a] & keys[b]


def test_filter_of_ids_loses_none(spark, monkeypatch):
    for bits in (1 << 26, 1 << 16):
        monkeypatch.setattr(cluster, "FILTER_BITS", bits)
        df = spark.range(20_000).withColumn("x", F.lit(1))
        ids = spark.range(0, 20_000, 7)
        kept = {r.id for r in cluster.held_by(df, ids, "id").collect()}
        assert set(range(0, 20_000, 7)) <= kept and len(kept) < (3000 if bits > 1 << 20 else 5000)
    assert cluster.held_by(spark.range(5), spark.range(0), "id").count() == 0


def test_words_of_any_structure_have_hashes_of_their_own():
    import numpy as np

    from verdictframe.llm.text_kernel import run_hashes

    flip = str.maketrans("ab", "ba")
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(flip)
    runs = [thue, thue.translate(flip), "", *("x" * k for k in range(1, 300)), *(thue[:k] for k in (128, 255, 256, 257, 1024)), *(thue.translate(flip)[:k] for k in (128, 255, 256, 257, 1024))]
    runs = sorted(set(runs) | {r + "\0" for r in runs})
    data = np.frombuffer("".join(runs * 2).encode(), np.uint8)
    size = np.array([len(r) for r in runs * 2])
    ends = np.cumsum(size)
    found = run_hashes(data, ends - size, ends)
    assert (found[: len(runs)] == found[len(runs) :]).all() and len(np.unique(found)) == len(runs)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    same = "p q r s t u v w x y z"
    found = near_dedup.near_duplicates(spark.createDataFrame([(None, same), (7, same), (None, "other words entirely here now"), (None, None)], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == Counter([(None, 7, False), (7, 7, True), (None, None, True), (None, None, True)])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(values[:2000]), np.sort(values[1000:])
    s = near_dedup.superminhash(np.concatenate([a, b]), np.array([2000, 2000]))
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12
    few = near_dedup.superminhash(values[:3], np.array([0, 1, 2]))
    assert few.shape == (3, near_dedup.SLOTS)


@pytest.mark.parametrize("at_once", [10**6, 0])
def test_components_on_both_ways(spark, at_once):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4), at_once).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long"), at_once).count() == 0


ITEMS = [(1, "the of the of the of the of the of the of the of"), (2, "w1 w2 w3"), (3, None), (4, "..."), (5, None), (6, "one two THREE"), (7, "one two three")]


def contamination(rows, items, window=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words(ALNUM, text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    lengths = {len(k) for k in windows}
    out = []
    for d, text, *_ in rows:
        w, hit, found = words(ALNUM, text), set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def leaky(rows):
    """The corpus with passages of it as items: inner ones, whole short texts, overlapping ones."""
    items = list(ITEMS)
    for k, (_, text, *_) in enumerate(rows[15:60:4]):
        w = words(ALNUM, text)
        items.append((100 + k, " ".join(w[3:25])))
        items.append((200 + k, "Zz yy " + " ".join(w[:14]).upper()))
    return items


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_contamination_equals_brute_force(spark, docs, rows, leaky, block_words):
    benchmark = spark.createDataFrame(leaky, "item_id long, text string")
    items = clashing(benchmark.withColumnRenamed("item_id", "i")).drop("item_id").withColumnRenamed("i", "item_id")
    got = Counter(tuple(r)[:6] for r in decontaminate.report(clashing(docs), items, block_words=block_words).collect())
    assert got == contamination(rows, leaky)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 200])
def test_decontaminate_removes_affected_rows_only(spark, docs, rows, leaky, block_words):
    benchmark = spark.createDataFrame(leaky, "item_id long, text string")
    clean = decontaminate.decontaminate(clashing(docs), benchmark, block_words=block_words)
    assert clean.columns == clashing(docs).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for (d, *_, hit), k in contamination(rows, leaky).items() for _ in range(k) if not hit)


def test_longest_matches_have_their_places(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y"), (2, None)], "doc_id long, text string")
    item = spark.createDataFrame([("q", "0 a b c d e f g h i j k l 9")], "item_id string, text string")
    found = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.contamination(docs, item).collect()}
    assert found == {1: [("q", 1, 1, 12)], 2: []}


def longest_matches(text, items, window=10):
    """(start, length) of the longest runs of at least a window shared with an item that lie in no longer one."""
    w, tests = words(ALNUM, text), [words(ALNUM, t) for _, t in items]
    own = []
    for p in range(len(w)):
        best = 0
        for t in tests:
            for q in range(len(t)):
                n = 0
                while p + n < len(w) and q + n < len(t) and w[p + n] == t[q + n]:
                    n += 1
                best = max(best, n)
        own.append(best)
    return [(p, n) for p, n in enumerate(own) if n >= window and (p == 0 or own[p - 1] <= n)]


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(10, 40)))) for k in range(25)]
    items += [(30, items[0][1]), (31, "a " * 60), (32, items[1][1] + " a b")]
    texts = [(k, " ".join(rng.choice("abc") for _ in range(150)) + " z " + items[k][1] + " " + items[k + 1][1]) for k in range(12)] + [(50, "a " * 200), (51, "")]
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by_id = {str(i): words(ALNUM, t) for i, t in items}
    for r in found:
        w = words(ALNUM, r.text)
        assert [(m.start, m.length) for m in r.matches] == longest_matches(r.text, items)
        for m in r.matches:
            assert by_id[m.item_id][m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length]


def test_hits_come_from_the_search_in_the_suffix_array(monkeypatch):
    import pyarrow as pa

    item = "a b c d e f g h i j k l"
    test = decontaminate.TestSet(["q", "short"], [item, "m n"], 10)
    column = pa.array(["x " + item + " y m n " + item])
    n_words, spans, items, matches = decontaminate.scan_texts(test, column)
    assert items.to_pylist() == [["q", "short"]] and [(m["start"], m["length"]) for m in matches[0].as_py()] == [(1, 12), (14, 2), (16, 12)]
    monkeypatch.setattr(decontaminate.Shard, "search", lambda self, w: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert [x.to_pylist() for x in decontaminate.scan_texts(test, column)] == [n_words.to_pylist(), [[]], [[]], [[]]]


def test_periodic_texts_stay_linear():
    import time

    import pyarrow as pa

    test = decontaminate.TestSet(list(range(300)), ["x " * 400] * 300, 10)
    began = time.perf_counter()
    n_words, spans, items, matches = decontaminate.scan_texts(test, pa.array(["x " * 40_000, "y"]))
    assert time.perf_counter() - began < 10
    assert (n_words.to_pylist(), len(items[0]), spans.to_pylist()) == ([40_000, 1], 300, [[{"start": 0, "length": 40_000}], []])
    assert len(matches[0]) <= 40_000


def test_contamination_of_empty_tables(spark, docs, rows):
    assert decontaminate.report(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    none = decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(rows) and none.where("contaminated").count() == 0


def base(text):
    text = text or ""
    w = words(SPACED, text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


LINES = ["a b\na b\n\n \na b ", "same\nsame\nsame", "#*$ %&|<> x", "go go go go go go", "ab\r\nab\r\n", "é é\né é"]


def labels_of(spark, rows):
    return spark.createDataFrame([(d, int(not (t or "").startswith("junk")), 0) for d, t, *_ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def junk_rows(rows):
    more = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(LINES)]
    return rows + more + [(2000 + i, "junk " + "*** !! " * (40 + i), "en", "s", 0) for i in range(60)]


def test_quality_rules(spark, rows):
    rows = junk_rows(rows)
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(3), labels_of(spark, rows)
    got = quality_rules.verdicts(clashing(docs), labels).collect()
    want = {d: base(t) for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        n, *_, repeat = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
        assert not (r.kept and r.doc_id >= 2000)
    kept = quality_rules.kept(clashing(docs), labels)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.verdicts(empty(spark), labels).count() == 0
    without = quality_rules.verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in without)


def test_trees_hold_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (800, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=800) < 0.15)).astype(float)
    forest = quality_rules.grow(x, y, np.array([-1, 0]), trees=15, depth=3)
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.3)], axis=1)
    assert (np.diff(forest.margins(grid)) <= 1e-9).all()
    assert ((forest.probabilities(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.9


def test_quality_classifier(spark, rows):
    rows = junk_rows(rows)
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(3), labels_of(spark, rows)
    got = quality_classifier.score(clashing(docs), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 2000]
    assert held and all(r.predicted == 0 for r in held)
    assert np.mean([r.predicted for r in got if r.held_out and 11 <= r.doc_id < 1000]) > 0.95
    kept = quality_classifier.accepted(clashing(docs), labels)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    assert quality_classifier.score(empty(spark), labels).count() == 0
    assert {r.score for r in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 9, 50).astype(float)
    ones = np.floor(n * rng.uniform(size=50))
    fitted = quality_classifier.isotonic(ones, n)
    assert (np.diff(fitted) >= -1e-12).all() and np.isclose((fitted * n).sum(), ones.sum())


def test_language(spark):
    rng = random.Random(1)
    sets = {"aa": ["kata", "moro", "tiki", "salu"], "bb": ["weng", "thirp", "stroff", "blick"], "ру": ["мама", "рама", "дом", "лес"]}
    rows = [(i, " ".join(rng.choice(sets[k]) for _ in range(30)), k) for i, k in enumerate(list(sets) * 40)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 456 !!", "bb"), (903, "kata moro tiki salu kata moro " + "weng thirp stroff blick weng thirp stroff", None), (904, "дом", None), (905, "😀 😀 «»", "aa"), (906, "ª", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in language.predict(clashing(docs)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[d].lang_pred == k for d, _, k in rows)
    assert [got[d].lang_pred for d in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "ру"]
    assert got[905].lang_pred == "und" and got[905].score == 0 and got[906].lang_pred in sets
    assert got[900].score == 0 and 0.5 < got[903].score < 0.6
    model = language.learn(docs)
    found = language.spans(docs.where("doc_id = 903"), model).orderBy("start_word").collect()
    assert [tuple(r) for r in found] == [(903, 0, 6, "aa"), (903, 6, 13, "bb")]
    nothing = language.predict(docs.limit(0))
    assert nothing.count() == 0
    unknown = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.predict(unknown).collect()] == [("und", 0.0)]


def test_three_hundred_languages_are_told_apart():
    """More labels than a byte holds."""
    rng = np.random.default_rng(3)
    truth = np.repeat(rng.integers(0, 300, 60), 30)
    scores = rng.normal(0, 1, (len(truth), 300))
    scores[np.arange(len(truth)), truth] += 30
    for segment in (7, 512):
        language.SEGMENT, before = segment, language.SEGMENT
        try:
            assert (language.viterbi(scores, np.array([len(truth)])) == truth).all()
        finally:
            language.SEGMENT = before


def path_value(s, path, penalty):
    return sum(s[t, k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("segment", [1, 2, 512])
def test_viterbi_equals_all_paths(monkeypatch, segment):
    import itertools

    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = np.random.default_rng(4)
    for n in range(1, 6):
        s = rng.normal(size=(n, 3))
        best = max(itertools.product(range(3), repeat=n), key=lambda p: path_value(s, p, 0.7))
        both = language.viterbi(np.concatenate([s, s[:1]]), np.array([n, 0, 1]), 0.7)
        assert tuple(both[:n]) == best and both[n] == s[0].argmax()


def plain_language_model(rows):
    """Trigram counts, scripts' use and word labels in plain Python: rows are (text, lang)."""
    import math
    import unicodedata

    def trigrams(data):
        clean = [b if b >= 128 or chr(b).isalnum() else 32 for b in data]
        out = []
        for i, b in enumerate(clean):
            key = ((clean[i - 1] if i else 32) * 0x9E3779B1 + b * 0x85EBCA77 + (clean[i + 1] if i + 1 < len(clean) else 32) * 0xC2B2AE3D) % 2**32
            key ^= key >> 15
            out.append((key * 0x27D4EB2F % 2**32) >> 17)
        return out

    def word_spans(data):
        return [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]

    def script(word):
        return next((unicodedata.name(c).split()[0] for c in word.decode() if c.isalpha()), None)

    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        data = text.lower().encode()
        g = trigrams(data)
        for a, b in word_spans(data):
            grams[lang].update(g[a:b])
            if k := script(data[a:b]):
                scripts[lang][k] += sum(map(str.isalpha, data[a:b].decode()))
    languages = sorted(grams)
    total = {x: sum(grams[x].values()) + 0.5 * language.BUCKETS for x in languages}

    def log(x, g):
        return math.log((grams[x][g] + 0.5) / total[x])

    def predict(text):
        data = text.lower().encode()
        g, scores = trigrams(data), []
        for a, b in word_spans(data):
            k = script(data[a:b])
            if k is None:
                continue
            able = [x for x in languages if scripts[x][k] >= 0.01 * max(1, sum(scripts[x].values()))] or languages
            scores.append([sum(log(x, t) - sum(log(y, t) for y in languages) / len(languages) for t in g[a:b]) - (0 if x in able else 1e3) for x in languages])
        best, back = scores[0], []
        for s in scores[1:]:
            top = max(range(len(languages)), key=lambda k: best[k])
            came = [top if best[top] - language.SWITCH_PENALTY > best[k] else k for k in range(len(languages))]
            best = [max(best[k], best[top] - language.SWITCH_PENALTY) + s[k] for k in range(len(languages))]
            back.append(came)
        path = [max(range(len(languages)), key=lambda k: best[k])]
        for came in reversed(back):
            path.append(came[path[-1]])
        votes = Counter(path)
        k = min(votes, key=lambda k: (-votes[k], k))
        return languages[k], votes[k] / len(path)

    return predict


def test_language_equals_a_plain_model(spark, monkeypatch):
    rng = random.Random(21)
    sets = {"aa": ["kata", "moro", "tiki", "salu", "été"], "bb": ["kata", "weng", "thirp", "blick", "groß"], "ру": ["мама", "рама", "дом", "лес"], "zz": ["𠀀𠀁", "一二"]}
    rows = [(i, " ".join(rng.choice(sets[k]) for _ in range(30)), k) for i, k in enumerate(list(sets) * 20)]
    mixed = [(100 + i, " ".join(rng.choice(sets[rng.choice(list(sets))] if rng.random() < 0.1 else sets[k]) for k in rng.choices(list(sets), k=3) for _ in range(40)), None) for i in range(40)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    model = language.learn(docs)
    predict = plain_language_model([(t, k) for _, t, k in rows])
    want = {d: predict(t) for d, t, _ in rows + mixed}
    for r in language.identify(docs, model).collect():
        assert (r.lang_pred, pytest.approx(r.score)) == want[r.doc_id]
    import pyarrow as pa

    texts = pa.array([t for _, t, _ in rows + mixed] + [" ".join(t for _, t, _ in mixed), None, "x" * 3000, "1 " * 900 + "дом"])
    counts, labels = language.label_words(texts, model)
    for chunk, segment in ((64, 7), (500, 512), (1 << 19, 16)):
        monkeypatch.setattr(language, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(language, "SEGMENT", segment)
        got = language.label_words(texts, model)
        assert (got[0] == counts).all() and (got[1] == labels).all()
    assert list(language._written(pa.array(["1 2", None, "дом", "a", "1" * 5000 + "é", "𠀀", "😀"]))) == [False, False, True, True, True, True, False]


NOTICES = ["Licensed under the Apache License, Version 2.0.", "x GNU GENERAL PUBLIC LICENSE gnu general public license y", "cc by cc by", "mit\nlicense mit license", "Released under the MIT License. All rights reserved.", "gnu general public licenses", "the the the of"]


_HEAD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_FREE = "{0} This program is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
#: Text: labels.
MATRIX = {
    _FREE.format("A.", "", "2"): "gpl,gpl-2.0-or-later",
    _FREE.format("B.", "", "3"): "gpl,gpl-3.0-or-later",
    _FREE.format("C.", "Lesser ", "2.1"): "lgpl-2.1-or-later",
    _FREE.format("D.", "Lesser ", "3"): "lgpl-3.0-or-later",
    _FREE.format("E.", "Affero ", "3"): "agpl-3.0-or-later",
    "F. You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    f"G. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_HEAD} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS": "bsd-2-clause",
    f"H. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_HEAD} 3. Neither the name of ACME Example Incorporated nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE AUTHORS": "bsd-3-clause",
    "I. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: see elsewhere": "bsd",
    f"J. {_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    f"K. {_GRANT}. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES": "0bsd",
    f"L. {_GRANT} to those who ask": "isc-like",
    "M. Permission is hereby granted, free of charge, to any natural person or to any company obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "mit-notice",
    "N. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0",
    "O. either version 3 of the license, then much else " + "and so on " * 40 + _FREE.format("", "", "2"): "gpl,gpl-2.0-or-later",
}


def test_license_scan(spark, rows):
    rows = [*rows, *((3000 + i, t, "en", "s", 0) for i, t in enumerate(NOTICES)), (3001, NOTICES[1], "en", "s", 0)]
    got = license_scan.scan(clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        w = words(ALNUM, texts[r.doc_id])
        places, found = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(found)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r.labels for r in got}
    assert by[3000] == "apache,apache-2.0" and by[3004] == "mit,mit-notice,proprietary" and by[3006] == ""
    assert license_scan.scan(empty(spark)).count() == 0


def plain_matches(text):
    """The labels, their best share and the number of matches by trying each piece of each template at each place."""
    w, labels, share, n = words(ALNUM, text), set(), 0.0, 0
    pieces = license_scan.pieces_of(license_scan.TEMPLATES)
    for k, (label, notice, phrases) in enumerate(license_scan.TEMPLATES):
        size, stands, found = len(notice.split()), [], {}
        for j, p in enumerate(pieces):
            if p.template == k:
                for start in range(-len(p.words), len(w)):
                    agree = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(p.words))
                    if agree == len(p.words) if p.phrase else agree >= -(-len(p.words) * 6 // 10):
                        stands.append((start - p.offset, j, agree, p.phrase))
        for bucket in {b // license_scan.DRIFT - d for b, *_ in stands for d in (0, 1)}:
            near = [s for s in stands if 0 <= s[0] - bucket * license_scan.DRIFT < 2 * license_scan.DRIFT]
            best = {}
            for begin, j, agree, phrase in near:
                old = best.get(j, (0, begin, phrase))
                best[j] = (max(old[0], agree), min(old[1], begin), phrase)
            total = sum(a for a, _, phrase in best.values() if not phrase)
            if total >= -(-size * 6 // 10) and sum(phrase for *_, phrase in best.values()) == len(phrases):
                start = min(b for _, b, _ in best.values())
                found[start] = max(found.get(start, 0), total / size)
        if found:
            labels, share, n = labels | {label}, max(share, *found.values()), n + len(found)
    for family, members in license_scan.FAMILIES.items():
        if labels & set(members):
            labels -= {family}
    return labels, share, n


def test_license_scan_equals_a_scan_of_all_places(spark):
    rng = random.Random(4)
    notices = [notice for _, notice, _ in license_scan.TEMPLATES]
    long = [n for n in notices if len(n.split()) > 15]
    texts = [*notices, ". ".join(notices), *NOTICES, *ODD]
    for _ in range(60):
        w = [x if rng.random() > 0.25 else rng.choice(["software", "the", "zz", "license"]) for n in rng.sample(notices, 3) for x in [*n.split(), *["filler"] * rng.randrange(4)]]
        texts.append(" ".join(w[rng.randrange(5) :]))
    texts += [*MATRIX, f"{long[1]}. {long[2]}", "unencumbered mozilla gnu foundation " + "other words " * 5000 + long[-1]]
    texts += [long[2]] * 100  # a notice that every other text carries
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        labels, share, n = plain_matches(texts[r.doc_id])
        base = set(r.base_labels.split(",")) - {""}
        assert r.labels == ",".join(sorted(labels | base)) and r.n_matches == n
        assert r.score == (1.0 if base else pytest.approx(share))


@pytest.mark.parametrize("texts", [["mit"] * 2, ["mit"] * 10 + ["none"] * 90, ["mit", "bsd-3-clause"], ["bsd-3-clause"] * 40 + ["isc"] * 40])
def test_license_labels_do_not_depend_on_the_table(spark, texts):
    notice = {label: n for label, n, _ in license_scan.TEMPLATES if len(n.split()) > 15} | {"none": "nothing of that kind", "mit": "Released under the MIT License"}
    found = license_scan.scan(spark.createDataFrame([(i, notice[t]) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.labels == {"none": "", "mit": "mit,mit-notice"}.get(texts[r.doc_id], texts[r.doc_id]) for r in found)


def test_license_labels_tell_versions_and_clauses_apart(spark):
    found = license_scan.scan(spark.createDataFrame(list(enumerate(MATRIX)), "doc_id long, text string")).collect()
    texts = list(MATRIX)
    assert {texts[r.doc_id]: r.labels for r in found} == MATRIX


def test_license_scan_of_long_texts(spark):
    """A notice in every tenth part of a megabyte, and a megabyte of one notice's words."""
    notice = next(n for label, n, _ in license_scan.TEMPLATES if label == "gpl-2.0-or-later")
    texts = [("filler words of no notice " * 4000 + notice + ". ") * 10, "permission is hereby granted free of charge " * 20_000]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "gpl,gpl-2.0-or-later" and got[0].n_matches == 10 and got[1].labels == ""


def plain_best_fit(pieces, capacity, most):
    bins, needed = [], max(1, -(-sum(p[0] for p in pieces) // capacity))
    limit = {s: max(most, -(-2 * n // needed)) for s, n in Counter(p[2] for p in pieces).items()}
    for p in sorted(pieces, key=lambda p: (-p[0], p[1], p[3] is None, p[3] or 0, p[4])):
        fits = [b for b in bins if b["room"] >= p[0] and p[1] not in b["clusters"] and b["sources"][p[2]] < limit[p[2]]]
        if not fits:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter(), "no": len(bins), "pieces": []})
            fits = [bins[-1]]
        b = min(fits, key=lambda b: (b["room"], b["no"]))
        b["room"] -= p[0]
        b["clusters"].add(p[1])
        b["sources"][p[2]] += 1
        b["pieces"].append(p)
    return sorted((b["room"], sorted(map(str, b["pieces"]))) for b in bins)


@pytest.mark.parametrize(("clusters", "sources", "most"), [(40, 6, 2), (3, 6, 2), (300, 1, 2), (200, 2, 1), (1, 300, 4)])
def test_best_fit_equals_search_of_all_bins(monkeypatch, clusters, sources, most):
    monkeypatch.setattr(packing, "LARGE_CLUSTER", 5)
    for seed in range(5):
        rng = random.Random(seed)
        pieces = [(rng.randrange(1, 100), rng.randrange(clusters) * 64, rng.randrange(sources) * 64, i, 0) for i in range(300)]
        got = packing.best_fit(pieces, 100, most)
        assert sorted((room, sorted(map(str, m))) for room, m in got) == plain_best_fit(pieces, 100, most)


def test_best_fit_of_one_source_or_one_cluster_is_fast():
    import time

    rng = random.Random(2)
    one_source = [(rng.randrange(1, 200), i, 5, i, 0) for i in range(40_000)]
    one_cluster = [(rng.randrange(1, 200), i if i % 3 else 7, i % 50, i, 0) for i in range(20_000)]
    for pieces in (one_source, one_cluster):
        began = time.perf_counter()
        bins = packing.best_fit(pieces, 2048, 4)
        assert time.perf_counter() - began < 5
        assert sum(len(m) for _, m in bins) == len(pieces)
    assert sum(room for room, _ in packing.best_fit(one_source, 2048, 4)) < 0.1 * sum(p[0] for p in one_source)


def test_packing_holds_every_word_once(spark, docs, rows):
    got = packing.pack(clashing(docs), capacity=64, shard_words=3000).collect()
    pieces = Counter()
    for b in got:
        assert b.used == sum(b.lengths) <= 64 and b.used + b.residual == 64
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            pieces[d, s, n] += 1
    want = Counter()
    for d, text, *_ in rows:
        n = len(words(SPACED, text))
        for s in range(0, n, 64):
            want[d, s, min(64, n - s)] += 1
    assert pieces == want
    same = {d: " ".join(words(SPACED, t)) for d, t, *_ in rows}
    assert all(len({same[d] for d in b.doc_ids}) == len(b.doc_ids) for b in got)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_keeps_near_copies_apart(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:30], "edited", *base[31:]])
    texts = [(1, " ".join(base), "a"), (2, near, "b"), (None, " ".join(base).upper(), "c"), (4, "quite other words", "d")]
    rows = spark.createDataFrame(texts, "doc_id long, text string, source string")
    bins = [set(r.doc_ids) for r in packing.pack_apart(rows).collect()]
    assert sorted(map(len, bins)) == [1, 1, 2] and not any(len(b & {1, 2, None}) > 1 for b in bins)
    named = spark.createDataFrame([(*t, c) for t, c in zip(texts, (7, 7, None, 7), strict=True)], "doc_id long, text string, source string, component_id long")
    apart = [set(r.doc_ids) for r in packing.pack(named, cluster="component_id").collect()]
    assert len(apart) == 3 and not any(len(b & {1, 2, 4}) > 1 for b in apart)


def test_chat_recovers_marked_turns():
    text = "System: Be kind.\n\nUser: Hello there?\nSecond line\n\nAssistant: Fine.\n\n### Human:\nMore\n"
    lines, features = chat.observe(text)
    assert lines == ["Be kind.", "Hello there?", "Second line", "Fine.", "", "More"]
    assert list(features[:, 0]) == [0, 1, chat.NO_MARKER, 2, 1, chat.NO_MARKER]
    turns = chat.turns_of(lines, np.array([0, 1, 5, 2, 1, 5]))
    assert turns == [("system", "Be kind."), ("user", "Hello there?\nSecond line"), ("assistant", "Fine."), ("user", "More")]
    assert chat.render(turns[:1]) == "<|system|>\nBe kind.\n<|end|>\n"


def conversations(rng, n=60, longest=7):
    rows = []
    for c in range(n):
        if c % 5 == 0:
            rows.append((c, -1, "system", "x" * 40 + "."))
        for t in range(rng.randrange(2, longest)):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, "\n".join("x" * rng.randrange(5, 30) for _ in range(1 if role == "user" else 4)) + ("?" if role == "user" else ".")))
    return rows


def test_chat_over_conversations(spark):
    rows = conversations(random.Random(6))
    rows += [(None, 0, "user", "kept"), (70, None, "user", "first"), (71, 0, "user", None), (72, 0, "narrator", "x"), (73, 200, "user", "late"), (74, 0, None, " "), (75, 0, "tool", "a"), (75, 0, "tool", "a")]
    blocks = chat.transcripts(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    model = chat.learn(blocks)
    got = chat.recovered(blocks, model).collect()
    assert sum(r.n_turns for r in got) == len(rows) and {(r.conv_id, r.block) for r in got} >= {(None, 0), (71, 0), (73, 3)}
    right = sum(r.lines_right for r in got) / sum(r.n_lines for r in got)
    assert right > 0.95
    raw = spark.createDataFrame([("User: Hi?\n\nAssistant: Yes.",), (None,), ("",)], "text string")
    parsed = chat.parse(raw, model).collect()
    assert [(t.role, t.text) for t in parsed[0].turns] == [("user", "Hi?"), ("assistant", "Yes.")] and [r.rendered for r in parsed[1:]] == ["", ""]
    assert chat.recovered(blocks.limit(0), chat.learn(blocks.limit(0))).count() == 0


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_long_conversations_are_decoded_in_one_piece(spark, monkeypatch, broadcast_rows):
    """Blocks put together are what one Viterbi path over the whole transcript gives, also with gaps and crowded blocks."""
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    monkeypatch.setattr(chat, "BLOCK_ROWS", 6)
    rows = [(c, t * (1 + c % 3) if c % 3 < 2 else t, r, x) for c, t, r, x in conversations(random.Random(7), 30, 60)] + [(90, 1, "user", f"same {i}") for i in range(20)]
    blocks = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    model = chat.learn(blocks)
    stored, found = defaultdict(list), defaultdict(list)
    for r in blocks.orderBy("conv_id", "block", "part").collect():
        stored[r.conv_id] += [(t.turn, t.role, t.text) for t in r.turns]
    for r in chat.recovered(blocks, model).orderBy("conv_id", "block", "part").collect():
        turns = [(t.role, t.text) for t in r.turns]
        if r.goes_on:
            role, text = found[r.conv_id].pop()
            turns[0] = (role, f"{text}\n{turns[0][1]}")
        found[r.conv_id] += turns
        assert r.rendered == chat.render([(t.role, t.text) for t in r.turns])
    assert sum(map(len, stored.values())) == len(rows)
    for c, turns in stored.items():
        whole = chat.raw_transcript(c, turns)
        assert found[c] == chat.turns_of(whole.lines, chat.viterbi(whole.features, model))
        lines, features = chat.observe(whole.text)
        assert lines == whole.lines and (features == whole.features).all() and len(whole.states) == len(lines)


def test_transfer_matrices_hold_the_best_paths():
    rng = np.random.default_rng(5)
    model = chat.model_of(rng.integers(0, 9, chat.SIZE).astype(float))
    features = np.stack([rng.integers(0, w, 9) for w in chat.WIDTHS], axis=1)
    def value(states, before):
        first = model.start[states[0]] if before is None else model.transition[before, states[0]]
        return first + chat.seen(features, model)[np.arange(9), states].sum() + model.transition[states[:-1], states[1:]].sum()

    matrix = chat.transfer(features, model)
    for before in (None, 0, 5):
        for last in range(chat.STATES):
            states = chat.viterbi(features, model, before, last)
            assert states[-1] == last and np.isclose(value(states, before), matrix[chat.STATES if before is None else before, last])


#: Transcripts in styles that the library doesn't write itself, and their turns.
PASTED = [
    ("Human: What is it?\n\nAI: A tree.\n\nHuman: Where?\n\nAI: There.", [("user", "What is it?"), ("assistant", "A tree."), ("user", "Where?"), ("assistant", "There.")]),
    ("### Question\nHow far?\n\n### Answer\nTen miles.\nOr so.", [("user", "How far?"), ("assistant", "Ten miles.\nOr so.")]),
    ("[SYSTEM] Be kind.\n[USER] Hello?\n[BOT] Hi.", [("system", "Be kind."), ("user", "Hello?"), ("assistant", "Hi.")]),
    ("Q: One?\nA: Yes.\nQ: Two?\nA: No.", [("user", "One?"), ("assistant", "Yes."), ("user", "Two?"), ("assistant", "No.")]),
    ("user :  spaced?\n\nASSISTANT: loud.", [("user", "spaced?"), ("assistant", "loud.")]),
]


def test_chat_reads_other_styles(spark):
    blocks = chat.transcripts(spark.createDataFrame(conversations(random.Random(8)), "conv_id long, turn long, role string, text string"))
    parsed = chat.parse(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PASTED)], "i int, text string"), chat.learn(blocks))
    for r in parsed.collect():
        assert [(t.role, t.text) for t in r.turns] == PASTED[r.i][1]


def test_hmm_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    model = chat.model_of(rng.integers(0, 9, chat.SIZE).astype(float))
    features = np.array([[0, 1, 0, 0], [4, 2, 1, 1], [5, 0, 0, 1]])

    def value(path):
        seen = sum(e[s, features[t, k]] for t, s in enumerate(path) for k, e in enumerate(model.emission))
        return model.start[path[0]] + seen + sum(model.transition[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(itertools.product(range(chat.STATES), repeat=3), key=value)
    assert np.isclose(value(tuple(chat.viterbi(features, model))), value(best))
