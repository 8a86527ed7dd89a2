"""Queries that SQL can't express against plain Python over the whole output, on the smallest tables."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from verdictframe.functions import matching as M
from verdictframe.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def tables(sf):
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def events(tables):
    e = tables("events").sort_values(["ts", "event_id"])
    e["turn"], e["call_key"] = e.ts.dt.floor("h"), e.event_type + ":" + e.props
    return e


def found(spark, sf, name, *columns):
    return {r[0]: tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect()}


def test_elo(spark, sf, events):
    want = {}
    for kind, e in events.groupby("event_type"):
        users, ratings = [str(u) for u in e.user_id], defaultdict(lambda: 1000.0)
        for loser, winner in zip(users, users[1:]):
            if winner != loser:
                gain = 32 * (1 - 1 / (1 + 10 ** ((ratings[loser] - ratings[winner]) / 400)))
                ratings[winner] += gain
                ratings[loser] -= gain
        want[kind] = (round(sum(ratings.values()) / len(ratings), 6),)
    assert found(spark, sf, "win07_elo", "elo_score") == {k: (pytest.approx(v[0], abs=1e-6),) for k, v in want.items()}


def turns(e):
    return {u: [Counter(t.call_key) for _, t in sorted(g.groupby("turn"), key=lambda x: x[0])] for u, g in e.groupby("user_id")}


def test_trajectories(spark, sf, events):
    predicted, reference = turns(events[events.event_type.isin(["click", "view"])]), turns(events[events.event_type.isin(["view", "purchase"])])
    got = found(spark, sf, "agt02_trajectory_match", "trajectory_strict", "trajectory_in_order")
    assert set(got) == set(reference)
    for u, ref in reference.items():
        mine = predicted.get(u, [])
        calls = [c for turn in mine for c in sorted(turn.elements())]
        covered = at = 0
        for turn in ref:  # the shortest stretch from here that holds the turn
            stop = next((k for k in range(at, len(calls) + 1) if turn <= Counter(calls[at:k])), None)
            if stop is None:
                break
            covered, at = covered + 1, stop
        assert got[u] == (float(mine == ref), pytest.approx(covered / len(ref)))


def test_parallel_calls(spark, sf, events):
    predicted, reference = turns(events[events.value >= 20]), turns(events[events.value < 60])
    got = found(spark, sf, "agt03_parallel_calls", "parallel_recall", "parallel_precision", "parallel_detection")
    assert set(got) == set(reference)
    for u, ref in reference.items():
        mine, groups = predicted.get(u, []), [t for t in ref if t.total() > 1]
        pure = [max((t & r).total() for r in ref) == (t & sum(ref, Counter())).total() for t in mine if (t & sum(ref, Counter())).total() > 1]
        recall, precision, detection = got[u]
        assert precision == (pytest.approx(sum(pure) / len(pure)) if pure else None)
        assert detection == float(bool(groups) == any(t.total() > 1 for t in mine))
        assert (recall is None) == (not groups) and (recall is None or recall * len(groups) <= sum(any(g <= t for t in mine) for g in groups) + 1e-9)


def plain_scores(output, target):
    a, b = output.split(), target.split()

    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    logs = [math.log((sum((grams(a, n) & grams(b, n)).values()) / max(1, len(a) - n + 1)) or 1e-12) for n in range(1, min(4, max(len(a), len(b))) + 1)] if a and b else []
    bleu = min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(sum(logs) / len(logs)) if logs else 0.0
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    edits = np.zeros((len(a) + 1, len(b) + 1), int)
    edits[:, 0], edits[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
            edits[i, j] = min(edits[i - 1, j] + 1, edits[i, j - 1] + 1, edits[i - 1, j - 1] + (x != y))
    rouge = 2 * table[-1, -1] / (len(a) + len(b)) if a or b else 1.0
    accuracy = max(0.0, 1 - edits[-1, -1] / len(b)) if b else float(not a)
    p = r = 0.0
    orders = range(1, min(6, max(len(output), len(target))) + 1)
    for n in orders if output and target else ():
        x, y = grams(output, n), grams(target, n)
        p += sum((x & y).values()) / max(1, x.total()) / len(orders)
        r += sum((x & y).values()) / max(1, y.total()) / len(orders)
    return {"txt14_bleu": bleu, "txt15_rouge_l": rouge, "txt16_chrf": 2 * p * r / (p + r) if p + r else 0.0, "txt17_word_error_rate": accuracy}


def test_text_scores(spark, sf, tables):
    names = tables("part").set_index("p_partkey").p_name
    pairs = {k: (names[k], names[k + 1]) for k in names.index if k + 1 in names.index}
    want = {k: plain_scores(*x) for k, x in pairs.items()}
    for name in ("txt14_bleu", "txt15_rouge_l", "txt16_chrf", "txt17_word_error_rate"):
        assert found(spark, sf, name, "score") == {k: (pytest.approx(w[name], abs=1e-6),) for k, w in want.items()}


def table_row(a, b):
    """Common subsequence and edit distance by the last row of the whole table, in numpy."""
    y = np.array([{t: i for i, t in enumerate(dict.fromkeys(b))}[t] for t in b], np.int64)
    codes, at = {t: i for i, t in enumerate(dict.fromkeys(b))}, np.arange(len(b) + 1)
    shared, edits = np.zeros(len(b) + 1, np.int64), at.copy()
    for i, t in enumerate(a, 1):
        k = codes.get(t, -1)
        shared[1:] = np.maximum.accumulate(np.maximum(np.where(y == k, shared[:-1] + 1, shared[1:]), shared[1:]))
        full = np.concatenate([[i], np.minimum(edits[1:] + 1, edits[:-1] + (y != k))])
        edits = np.minimum.accumulate(full - at) + at
    return int(shared[-1]), int(edits[-1])


def test_bit_parallel_rows_equal_whole_tables(tables):
    from verdictframe.functions.bitparallel import common_subsequence, edit_distance

    rng = random.Random(7)
    for _ in range(1500):
        a, b = (rng.choices("abcd"[: rng.randrange(1, 5)], k=rng.randrange(70)) for _ in range(2))
        assert (common_subsequence(a, b), edit_distance(a, b)) == table_row(a, b)
    a, b = (rng.choices(range(50), k=n) for n in (3000, 2500))
    b[100:1500] = a[300:1700]
    assert (common_subsequence(a, b), edit_distance(b, a)) == table_row(a, b)
    texts = tables("documents").text.dropna().tolist()
    for x, y in list(zip(texts, texts[1:], strict=False))[:80]:
        assert (common_subsequence(x.split(), y.split()), edit_distance(x.split(), y.split())) == table_row(x.split(), y.split())


def test_long_texts_are_compared_fast(tables):
    from verdictframe.functions.bitparallel import common_subsequence, edit_distance

    rng = random.Random(1)
    a, b = (rng.choices(range(2000), k=20_000) for _ in range(2))
    began = time.perf_counter()
    common_subsequence(a, b), edit_distance(a, b)
    assert time.perf_counter() - began < 3  # the tables take half a minute


def test_text_scores_of_documents(spark, sf, tables):
    texts = tables("documents").set_index("doc_id").text
    pairs = {k: (texts[k], texts[k + 1]) for k in texts.index if k + 1 in texts.index}
    longest = max(pairs, key=lambda k: len(pairs[k][0].split()) * len(pairs[k][1].split()))
    a, b = (x.split() for x in pairs[longest])
    shared, edits = table_row(a, b)
    assert found(spark, sf, "txt15_rouge_l_documents", "score")[longest] == (pytest.approx(2 * shared / (len(a) + len(b)), abs=1e-6),)
    assert found(spark, sf, "txt17_word_error_rate_documents", "score")[longest] == (pytest.approx(max(0.0, 1 - edits / len(b)), abs=1e-6),)
    characters = found(spark, sf, "txt10_levenshtein_documents", "score")
    assert len(characters) == len(pairs)
    for k in sorted(pairs, key=lambda k: len(pairs[k][0]) + len(pairs[k][1]))[:40]:
        x, y = pairs[k]
        assert characters[k] == (pytest.approx(1 - table_row(x, y)[1] / max(len(x), len(y)) if x or y else 0.0, abs=1e-6),)
    chosen = [k for k in sorted(pairs) if len(pairs[k][0].split()) * len(pairs[k][1].split()) < 40_000][:12]
    want = {k: plain_scores(*pairs[k]) for k in chosen}
    for name in ("txt14_bleu", "txt15_rouge_l", "txt16_chrf", "txt17_word_error_rate"):
        got = found(spark, sf, f"{name}_documents", "score")
        assert len(got) == len(pairs)
        assert {k: got[k] for k in chosen} == {k: (pytest.approx(w[name], abs=1e-6),) for k, w in want.items()}


def test_bootstrap(spark, sf):
    from verdictframe.operators import comparison
    from verdictframe.plans.comparisons import two_runs

    pairs = sorted(tuple(r) for r in comparison.score_pairs(*two_runs(spark, sf)).select("sample_id", "baseline", "candidate").collect())
    d = np.array([c - b for _, b, c in pairs])
    rng = random.Random(42)
    means = np.array([d[[rng.randrange(len(d)) for _ in d]].mean() for _ in range(1000)])
    r = QUERIES["cmp01_paired_bootstrap"](spark, sf).first()
    assert (r.n, r.delta) == (len(d), pytest.approx(d.mean()))
    assert (r.ci_low, r.ci_high) == tuple(map(pytest.approx, np.quantile(means, [0.025, 0.975])))
    assert r.p_value == pytest.approx((np.sum(np.abs(means - d.mean()) >= abs(d.mean()) - 1e-9) + 1) / 1001)
    quick = QUERIES["cmp01_poisson_bootstrap"](spark, sf).first()
    assert quick.delta == pytest.approx(d.mean()) and abs(quick.ci_low - r.ci_low) < 4 * d.std() / math.sqrt(len(d))


def test_cycles():
    assert M.has_cycle(["a", "b", "a"]) and not M.has_cycle(["a", "a", "b"]) and M.has_cycle(["a", "b", "c", "b"])
