"""Agent episodes: tool-call metrics that are relational, trials, joins of cases with episodes, and verdict ladders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdictframe.operators.scoring import pass_at_k, pass_hat_k


def call_key(name: Column | str, arguments: Column | str) -> Column:
    """A canonical form of a call: its name and its arguments as JSON with sorted keys and no trailing zeros; null when they can't be read.

    An empty text is a call without arguments. It stays inside the JVM, unlike matching.canonical().
    """
    text = F.coalesce(F.nullif(F.trim(arguments), F.lit("")), F.lit("{}"))
    return F.concat(F.col(name) if isinstance(name, str) else name, F.lit(":"), F.to_json(F.try_parse_json(text)))


def tool_call_scores(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """tool_call_precision, recall, f1 and exact of each episode, by exact matching of calls.

    Both sides have episode_id and call_key (a canonical form of name and arguments). Exact matching of calls is an
    intersection of multisets, so it is one grouping; an episode without any call on either side scores 1.
    """
    sides = predicted.select("episode_id", "call_key", F.lit(1).alias("p"), F.lit(0).alias("r")).union(reference.select("episode_id", "call_key", F.lit(0).alias("p"), F.lit(1).alias("r")))
    keys = sides.groupBy("episode_id", "call_key").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    e = keys.groupBy("episode_id").agg(F.sum("p").alias("n_predicted"), F.sum("r").alias("n_reference"), F.sum(F.least("p", "r")).alias("shared"))
    p, r, s = F.col("n_predicted"), F.col("n_reference"), F.col("shared")
    return e.select(
        "episode_id",
        "n_predicted",
        "n_reference",
        F.when((p == 0) & (r == 0), 1.0).otherwise(F.coalesce(F.try_divide(s, p), F.lit(0.0))).alias("tool_call_precision"),
        F.when((p == 0) & (r == 0), 1.0).otherwise(F.coalesce(F.try_divide(s, r), F.lit(0.0))).alias("tool_call_recall"),
        F.when(p + r == 0, 1.0).otherwise(2 * s / (p + r)).alias("tool_call_f1"),
        ((p == r) & (s == p)).cast("double").alias("tool_call_exact"),
    )


def redundancy(calls: DataFrame) -> DataFrame:
    """redundant_tool_calls of each episode: repeated keys by calls; malformed calls (null key) are in the calls only."""
    keys = calls.groupBy("episode_id", "call_key").agg(F.count(F.lit(1)).alias("k"))
    by = keys.groupBy("episode_id").agg(F.sum("k").alias("n_calls"), F.sum(F.when(F.col("call_key").isNotNull(), F.col("k") - 1).otherwise(F.lit(0))).alias("repeats"), F.max(F.when(F.col("call_key").isNotNull(), F.col("k"))).alias("most"))
    return by.select("episode_id", "n_calls", (F.col("repeats") / F.col("n_calls")).alias("redundant_tool_calls"), F.coalesce(F.col("most") >= 3, F.lit(False)).alias("repeats_often"))


def turns(events: DataFrame, key: str) -> DataFrame:
    """events (episode_id, idx) with turn_no: a new turn whenever the key differs from the event before."""
    order = Window.partitionBy("episode_id").orderBy("idx")
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(order))).cast("int")
    first = F.row_number().over(order) == 1
    return events.withColumn("new__", F.when(first, F.lit(0)).otherwise(changed)).withColumn("turn_no", F.sum("new__").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new__")


def transitions(events: DataFrame, name: str) -> DataFrame:
    """How often one name follows another, over the consecutive events of each episode."""
    order = Window.partitionBy("episode_id").orderBy("idx")
    return events.withColumn("before", F.lag(name).over(order)).where("before is not null").groupBy("before", F.col(name).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def permission(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """tool_permission of each episode: the share of its calls (name) that its rules allow.

    rules has episode_id, allowed and denied (arrays; a null allows everything, or denies nothing). A denial wins.
    """
    joined = calls.join(rules, "episode_id", "left")
    denied = F.coalesce(F.array_contains("denied", F.col("name")), F.lit(False))
    allowed = F.coalesce(F.array_contains("allowed", F.col("name")), F.lit(True))
    return joined.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_calls"), F.avg((allowed & ~denied).cast("double")).alias("tool_permission"))


def reliability(trials: DataFrame, case: str, k: int = 2) -> DataFrame:
    """Verdict counts of each case's trials, pass@k, all-of-k, consistency, variance and the majority's verdict.

    Verdicts are success, failure, unknown and error; only the first two are decided.
    """
    v = F.col("verdict")
    counts = trials.groupBy(case).agg(*(F.count_if(v == x).alias(f"n_{x}") for x in ("success", "failure", "unknown", "error")))
    s, f = F.col("n_success"), F.col("n_failure")
    n = s + f
    p = F.try_divide(s, n)
    return counts.select(
        "*",
        pass_at_k(n, s, k).alias("pass_at_k"),
        pass_hat_k(n, s, k).alias("pass_hat_k"),
        F.when(n > 0, F.greatest(p, 1 - p)).alias("consistency"),
        (p * (1 - p)).alias("variance"),
        F.when(s > f, "success").when(f > s, "failure").otherwise("unknown").alias("verdict"),
        F.when(n <= 1, "unknown").otherwise("measured").alias("status"),
    )


def match_episodes(cases: DataFrame, episodes: DataFrame, trials: int = 1) -> DataFrame:
    """cases (case_id) left-joined with their first episodes (case_id, source_id, listed_no), by case_id, else source_id.

    Never by position; a case without an episode has a null episode_id and matched_by 'none'.
    """
    own = episodes.select(F.col("case_id").alias("key"), "episode_id", "listed_no", F.lit("case_id").alias("by")).where("key is not null")
    source = episodes.select(F.col("source_id").alias("key"), "episode_id", "listed_no", F.lit("source_id").alias("by")).where("key is not null")
    has_own = cases.join(own.select(F.col("key").alias("case_id")).distinct(), "case_id", "left_semi").select("case_id")
    by_own = has_own.join(own, F.col("case_id") == F.col("key"))
    by_source = cases.select("case_id").join(has_own, "case_id", "left_anti").join(source, F.col("case_id") == F.col("key"))
    ranked = by_own.unionByName(by_source).withColumn("trial", F.row_number().over(Window.partitionBy("case_id").orderBy("listed_no"))).where(F.col("trial") <= trials)
    matched = cases.select("case_id").join(ranked.select("case_id", "episode_id", "trial", "by"), "case_id", "left")
    return matched.select("case_id", "episode_id", "trial", F.coalesce("by", F.lit("none")).alias("matched_by"))


def unmatched_episodes(cases: DataFrame, episodes: DataFrame) -> DataFrame:
    return episodes.join(cases.select("case_id"), "case_id", "left_anti").join(cases.select(F.col("case_id").alias("source_id")), "source_id", "left_anti")


def status(target_error: Column, method_error: Column, exhausted: Column, judge_error: Column, eligible: Column, applicable: Column) -> Column:
    """The ladder of an evaluated case: the first condition that holds names its status."""
    return (
        F.when(target_error, "target_error").when(method_error, "method_error").when(exhausted, "budget_exhausted").when(judge_error, "judge_error").when(~applicable, "not_applicable").when(~eligible, "ineligible").otherwise("completed")
    )


def resolve_outcome(oracle: Column, judge: Column) -> Column:
    """The verdict of a case: what its state says beats what a judge says; no evidence is unknown, never failure."""
    return F.coalesce(F.when(oracle.isin("success", "failure"), oracle), F.when(judge.isin("success", "failure"), judge), F.lit("unknown"))


def elo(results: DataFrame, group: str, k: float = 32.0, initial: float = 1000.0) -> DataFrame:
    """elo_score: the mean rating of each group's players after its results (winner, loser) in the order of seq, held to 0..2000.

    The fold is sequential by definition: a group's results pass through one task as a sorted stream, of which the
    task holds the ratings of the group's players and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict[str, float] = {}
        key = None

        def row() -> pa.RecordBatch:
            score = min(2000.0, max(0.0, sum(ratings.values()) / len(ratings)))
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([score])], names=[group, "elo_score"])

        for batch in batches:
            for g, winner, loser in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ratings and g != key:
                    yield row()
                    ratings = {}
                key = g
                w, l = ratings.get(winner, initial), ratings.get(loser, initial)  # noqa: E741
                gain = k * (1 - 1 / (1 + 10 ** ((l - w) / 400)))
                ratings[winner] = w + gain
                ratings[loser] = ratings[winner] - gain if winner == loser else l - gain
        if ratings:
            yield row()

    kind = to_arrow_type(results.schema[group].dataType)
    ordered = results.repartition(group).sortWithinPartitions(group, "seq").select(group, "winner", "loser")
    return ordered.mapInArrow(run, f"`{group}` {results.schema[group].dataType.simpleString()}, elo_score double")


def best_route(scores: DataFrame) -> DataFrame:
    """The route of each episode that fits best (episode_id, route_no, f1, recall, strict, in_order), and what decided.

    Routes are compared by f1, recall, strict, in_order, and last by their place; decided_by is the first of these in
    which the best route is ahead of all others, 'only' for a single route.
    """
    keys = ["f1", "recall", "strict", "in_order"]
    w = Window.partitionBy("episode_id")
    ranked = scores.withColumn("place", F.row_number().over(w.orderBy(*(F.col(k).desc() for k in keys), "route_no"))).withColumn("n_routes", F.count(F.lit(1)).over(w))
    decided = F.when(F.col("n_routes") == 1, F.lit("only"))
    ahead = ranked
    for i, k in enumerate(keys):
        same = [F.col(x) for x in keys[: i + 1]]
        ahead = ahead.withColumn(f"ties_{k}", F.count(F.lit(1)).over(Window.partitionBy("episode_id", *same)))
        decided = decided.when(F.col(f"ties_{k}") == 1, F.lit(k))
    return ahead.withColumn("decided_by", decided.otherwise(F.lit("place"))).where("place = 1").select("episode_id", "route_no", *keys, "n_routes", "decided_by")


def evaluate_recorded(cases: DataFrame, episodes: DataFrame, trials: int = 1, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Recorded episodes against their cases: a row a trial, and a row a case.

    cases has case_id, expected (an answer) and most_steps; episodes has episode_id, case_id, source_id, listed_no,
    final_answer, n_steps, error and reward_verdict (what the source itself says, which decides nothing). A case
    without an episode is not_applicable, and its verdict unknown.
    """
    from verdictframe.operators import outcomes as O  # noqa: E741, N812

    matched = match_episodes(cases, episodes, trials).join(cases, "case_id").join(episodes.drop("case_id", "source_id", "listed_no"), "episode_id", "left")
    oracle = O.answer_assertion(F.col("final_answer"), F.col("expected"))
    verdict = F.when(F.col("error").isNotNull(), "error").otherwise(resolve_outcome(oracle, F.lit(None).cast("string")))
    exhausted = O.budget_exhausted(F.col("n_steps"), F.col("most_steps"), F.lit(None), F.lit(None))
    no = F.lit(False)
    state = status(F.col("error").isNotNull(), no, exhausted, no, F.lit(True), F.col("episode_id").isNotNull())
    rows = matched.select("case_id", "episode_id", "trial", "matched_by", state.alias("status"), verdict.alias("verdict"), O.disagreement(oracle, F.col("reward_verdict")).alias("disagrees"))
    return rows, reliability(rows, "case_id", k)


#: How long a rendered trace may be, and what stands for its middle and for calls where there are none.
TRACE_LENGTH, TRUNCATED, NO_CALLS = 6000, "\n...(truncated)...\n", "(no tool calls)"


def head_and_tail(text: Column, limit: int = TRACE_LENGTH) -> Column:
    """A text of at most so many characters, else its beginning (the task) and its end (the last actions)."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(TRUNCATED), F.right(text, F.lit(half))))


def render_trace(messages: DataFrame, limit: int = TRACE_LENGTH) -> DataFrame:
    """trace: a readable transcript of each episode's messages (episode_id, idx, role, content, calls) for a judge.

    calls is the text of a message's tool calls, or null.
    """
    content = F.coalesce("content", F.lit(""))
    called = F.concat(F.lit("] tool_calls: "), F.col("calls"), F.when(content != "", F.concat(F.lit(" | "), content)).otherwise(""))
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("?")), F.coalesce(called, F.concat(F.lit("] "), content)))
    by = messages.select("episode_id", F.struct("idx", line.alias("line")).alias("m"), "calls").groupBy("episode_id").agg(F.array_sort(F.collect_list("m")).alias("m"), F.count("calls").alias("n_calls"))
    lines = F.transform("m", lambda x: x["line"])
    text = F.array_join(F.when(F.col("n_calls") == 0, F.array_append(lines, F.lit(NO_CALLS))).otherwise(lines), "\n")
    return by.select("episode_id", head_and_tail(text, limit).alias("trace"))


#: Fixed value: so many routes may one reference name.
MOST_ROUTES = 64


def score_routes(predicted: DataFrame, routes: DataFrame) -> DataFrame:
    """episode_id, route_no, f1, recall, strict and in_order of each route (episode_id, route_no, turn, call_key) of a reference.

    predicted has episode_id, turn and call_key. More than MOST_ROUTES routes of an episode raise.
    """
    from verdictframe.functions.matching import trajectory

    most = routes.groupBy("episode_id").agg(F.count_distinct("route_no").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most > MOST_ROUTES:
        raise ValueError(f"a reference names {most} routes; {MOST_ROUTES} at most")
    names = routes.select("episode_id", "route_no").distinct()
    both = F.struct("episode_id", "route_no").alias("episode_id")
    mine = predicted.join(names, "episode_id").select(both, "turn", "call_key")
    theirs = routes.select(both, "turn", "call_key")
    overlap = tool_call_scores(mine, theirs).select("episode_id", F.col("tool_call_f1").alias("f1"), F.col("tool_call_recall").alias("recall"))
    found = trajectory(mine, theirs).join(overlap, "episode_id")
    return found.select("episode_id.episode_id", "episode_id.route_no", "f1", "recall", F.col("trajectory_strict").alias("strict"), F.col("trajectory_in_order").alias("in_order"))
