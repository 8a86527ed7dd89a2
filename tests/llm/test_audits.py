"""Personal data and the two audits against plain Python, on texts that are null, empty, long, repeated and odd."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.llm.test_text_operators import LOWER, ODD, SCHEMA, clashing, empty
from verdictframe.llm import filter_audit, pii, quality_rules, source_audit

PHRASES = [
    "write to a.b-c@mail.example.org now", "+1 (017) 555-7713", "call +49 30 1234567 or +1 5", "4952935900253052", "4952 9359 0025 3052!", "4952-9359-0025-3053",
    "10.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", "007.0.00.255", "a@b@c.example", "x@y.com_z@w.org", "x@y.com..z@w.org", "+12345678901234567", "00000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 3",
    "mail: jane (at) home (dot) net", "phone (555) 555-1234", "version 4.0.1 of 2024-01-15", "12345678901234567890123", "é@ü.com", "😀+1 2345 67890😀 k@l.mn", "@a.b", "a@-.-", "+1 23456789 .-", "1-2-3-4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def personal_rows():
    rng = random.Random(3)
    texts = [*ODD, *PHRASES, "9" * 3000, "x" * 20_000 + "@" + "a." * 3000 + "b", ("+1 (555) 555-0000 " * 200), " ".join(PHRASES * 3)]
    for _ in range(120):
        texts.append(" ".join(rng.choice(["wort", "and", "the", "été", *PHRASES, f"u{rng.randrange(99)}@h{rng.randrange(9)}.example.com", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", ".".join(str(rng.randrange(300)) for _ in range(4))]) for _ in range(rng.randrange(1, 40))))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[30], (None, PHRASES[0], None, None, 0)]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    # a megabyte of one run costs the plain expression its square, so that long runs without @ are cut first
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def personal(spark):
    rows = personal_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_personal_data_base_spans_equal_plain_expressions(spark, personal):
    rows, docs = personal
    found = pii.report(clashing(docs)).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for doc, text, *_ in rows:
        spans = base_spans(text or "")
        n = Counter(k for k, *_ in spans)
        expected[(doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(spans).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == expected
    for r in found:
        text = next((t for d, t, *_ in rows if d == r["doc_id"]), "") or ""
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(text)} <= set(spans) and len(spans) == len(set(spans))
        places = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert places == sorted(places)


def learned(spark, n=260):
    """Texts with base spans of every kind to learn from, and held-out texts with other forms."""
    rng = random.Random(8)

    def card():
        head = "".join(str(rng.randrange(10)) for _ in range(15))
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    make = [lambda: f"n{rng.randrange(999)}.x@m{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"]
    rows = [(i, f"wort and {make[i % 4]()} then {make[rng.randrange(4)]()} was in {rng.randrange(1900, 2100)} and 12-2024-{rng.randrange(100, 999)} too", "en", "s", 0) for i in range(n)]
    others = [
        (10_000, "write to jane.doe (at) example (dot) com please", "en", "s", 0),
        (10_001, "call (212) 555-0199 today", "en", "s", 0),
        (10_002, "the host 10.20.30[.]40 was down", "en", "s", 0),
        (10_003, "see 12-2024-333 of release 4.0.1 in 2024", "en", "s", 0),
        (10_004, "token b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "en", "s", 0),
    ]
    return spark.createDataFrame(rows + others, SCHEMA), dict((d, t) for d, t, *_ in others)


def test_personal_data_adds_other_forms_and_spares_numbers(spark):
    docs, others = learned(spark)
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs).where("doc_id >= 10000").collect()}
    texts = {d: [others[d][int(a) : int(b)] for _, a, b in (s.split(":") for s in spans.split(",") if s)] for d, spans in found.items()}
    assert texts[10_000] == ["jane.doe (at) example (dot) com"]
    assert texts[10_001] == ["(212) 555-0199"]
    assert texts[10_003] == [] and texts[10_004] == []
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("doc_id >= 10000").collect()}
    assert redacted[10_001] == "call [PHONE] today" and redacted[10_003] == others[10_003]


def test_personal_data_trees_in_the_plan_equal_the_arrays(spark):
    docs, _ = learned(spark)
    spans = pii.located(pii.proposals(docs))
    model = pii.fit(spans, 1000)
    assert pii.fit(spans, 10**9, train_rows=30) is None and pii.fit(spans, 0) is None
    names = pii.features()
    rows = spans.where("kind is not null").withColumns(names).withColumn("p", model.probability(list(names))).collect()
    plain = quality_rules.Forest.probabilities(model.forest, np.array([[r[n] for n in names] for r in rows]))
    assert np.allclose([r["p"] for r in rows], plain, atol=1e-9)


def test_personal_data_thresholds_are_the_smallest_precise_ones():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = np.round(rng.random(200), 2)
        y = (rng.random(200) < p**0.3).astype(float)
        t = pii.threshold(p, y)
        ok = [c for c in np.unique(p) if y[p >= c].mean() >= pii.PRECISION]
        assert t == (max(0.5, min(ok)) if ok else 2.0)


def test_personal_data_of_nothing(spark):
    assert pii.report(empty(spark)).count() == 0
    nothing = pii.report(spark.createDataFrame([(1, None, "en", "s", 0), (1, "", None, None, 0)], SCHEMA)).collect()
    assert [(r["n_email"], r["spans"], r["base_sha256"]) for r in nothing] == [(0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_personal_data_in_long_texts_takes_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1." * 400_000, "+1" + "(" * 500_000, ("1 " * 500_000), "a@" + "b." * 300_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert pii.report(spark.createDataFrame(rows, SCHEMA)).count() == len(texts)


# --- source divergence


def source_rows(seed=4):
    rng = random.Random(seed)
    rows = [(i, t, "en", "s1", 0) for i, t in enumerate(ODD)]
    vocabulary = ["alpha", "Beta", "été", "Größe", "x", "don't", "a1b2"] + [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    for i in range(150):
        k = rng.choice([2, 4, len(vocabulary)])
        rows.append((100 + i, " ".join(rng.choice(vocabulary[:k]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), 0))
    rows += [rows[-1], rows[-1], (None, "alpha beta", "en", "s9", 0), (900, None, "fr", "only", 0), (901, "??", "fr", "other", 0), (902, "lone", "it", "one", 0)]
    return rows


def plain_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = [w.translate(LOWER) for w in term.findall(text or "")]
        counts[lang, source].update(found)
        df[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def prices(n, kept=kept, v=v):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * v) for t in kept}

        q, p = prices(whole), {s: prices(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs, top", [(10, 50), (1, 3), (500, 50)])
def test_source_divergence_equals_plain_sums(spark, min_docs, top):
    rows = source_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    found = source_audit.audit(docs, min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == plain_divergence(rows, min_docs, top)


def test_source_divergence_of_nothing(spark):
    assert source_audit.audit(empty(spark)).count() == 0


def test_terms_are_added_up_alike_with_small_bounds(spark, monkeypatch):
    """The task's sums don't depend on how often it sends them."""
    import pyarrow as pa

    rows = source_rows()
    batches = [pa.RecordBatch.from_arrays([pa.array([r[2] or ""]), pa.array([r[3] or ""]), pa.array([r[1]], pa.string())], names=["lang", "source", "text"]) for r in rows]

    def totals():
        total = Counter()
        for b in source_audit._count(iter(batches)):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[lang, source, term, "n"] += n
                total[lang, source, term, "docs"] += docs
        return total

    whole = totals()
    monkeypatch.setattr(source_audit, "PENDING", 7)
    assert totals() == whole


def test_prices_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(10**12, 3 * 10**13, 10**7), (0, 1, 1), (7 * 10**11 + 3, 7 * 10**11 + 3, 1), (5, 0, 0)]
    rows = spark.createDataFrame(big, "n long, total long, v long").select(source_audit.price(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in rows] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else None for n, t, v in big]


# --- filter interaction


def filter_rows(seed=6):
    rng = random.Random(seed)
    texts = [*ODD, "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, " ".join(["w"] * 100), " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), " ".join(f"w{i}" for i in range(99)), "\x1f".join("abc"), " lead and trail "]
    for _ in range(80):
        words = [rng.choice(["UP", "low", "w#", f"x{rng.randrange(200)}", "été"]) for _ in range(rng.choice([3, 90, 110, 150]))]
        texts.append(" ".join(words))
    texts += texts[5:40] + [None, ""]
    rows = [(i * 3 % 401, t, rng.choice(["en", "de", None, ""]), "s", 0) for i, t in enumerate(texts)]
    return rows + [rows[-5], (None, texts[20], "en", "s", 0), (None, texts[20], "en", "s", 0)]


def plain_interactions(rows, labels):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failures = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = space.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        good, toxic = (any(x == d and v[k] == 1 for x, *v in labels) for k in (0, 1))
        failures.append((lang or "", fails, good, toxic))
    out = []
    for part in {f[0] for f in failures}:
        own = [f for f in failures if f[0] == part]
        shapley, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for k, letter in enumerate(order):
                removed = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                unique = sum(f[1][letter] and sum(f[1].values()) == 1 for f in own)
                shapley[letter] += len(removed)
                found.append((letter, (part, order, k + 1, len(left), len(removed), sum(f[1][letter] for f in gone), unique, sum(f[2] for f in removed), sum(f[3] for f in removed))))
                gone = gone + removed
        out += [(*row, shapley[letter]) for letter, row in found]
    return sorted(out)


def test_filter_interactions_equal_plain_application(spark):
    rows = filter_rows()
    labels = [(d, q, t) for d, q, t in [(0, 1, 0), (3, 0, 1), (6, 1, 1), (9, None, 1), (12, 1, None), (12, 0, 0), (5000, 1, 1), (None, 1, 1)]] + [(3 * k, k % 2, k % 3 == 0 and 1 or 0) for k in range(5, 90)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(clashing(spark.createDataFrame(rows, SCHEMA).repartition(4)), table)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    labels = [x for x in labels if x[0] is not None]
    assert sorted(map(tuple, found.select(*columns).collect())) == plain_interactions(rows, labels)


def test_filter_interactions_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
    only_null = filter_audit.audit(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA), labels)
    assert only_null.count() == 600 and only_null.where("removed > 0").select("step").distinct().count() == 5
