"""Recorded agent runs of mixed shapes: what is read, what it covers, and the way back to messages."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from verdictframe.functions import structured
from verdictframe.sources import recorded as R


def call(name, id_, **arguments):
    return {"id": id_, "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}


CHAT = [
    {"role": "system", "content": "be brief"},
    {"role": "user", "content": "q"},
    {"role": "assistant", "content": "dropped", "tool_calls": [call("a", "1", x=1), call("b", "2")]},
    {"role": "tool", "tool_call_id": "1", "content": "r1"},
    {"role": "tool", "tool_call_id": "2", "content": "r2"},
    {"role": "assistant", "content": "done"},
]


def read(spark, *records):
    rows = [(str(k), r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)]
    return R.episodes(spark.createDataFrame(rows, "record_id string, record string"))


def one(spark, record):
    return read(spark, record).first()


def test_shapes_are_told_apart_and_unknown_ones_keep_a_reason(spark):
    records = [
        {"messages": CHAT}, CHAT, {"actual_trace": {}}, {"events": []}, {"question": "q", "final_answer": "a"}, {"steps": []}, {"trajectory_id": 1}, {"final_response": "x"},
        {"prompt": "p"}, {"idx": 1}, {"tool_calls": []}, {"b": 1, "a": 2}, {}, 3, "text", "{", None, "[" * 20_000, "[" * 101 + "]" * 101, "[" * 100 + "]" * 100,
    ]
    found = [(r.shape, r.reason) for r in sorted(read(spark, *records).collect(), key=lambda r: int(r.record_id))]
    assert [s for s, _ in found] == ["messages", "messages", "sample", "event_log", "rollout", "trajectory", "trajectory", "trajectory", "task", "report_row", "report_row"] + ["unknown"] * 9
    assert [r for _, r in found[11:]] == ["no known shape has the keys a, b", "neither an object nor a list of messages", "neither an object nor a list of messages", "no JSON", "no JSON", "no JSON", "nested deeper than 100 levels", "nested deeper than 100 levels", "neither an object nor a list of messages"]


def test_chat_covers_calls_made_and_calls_not_made(spark):
    full, silent, asked = read(spark, {"messages": CHAT}, {"messages": [{"role": "assistant", "content": "hi"}]}, {"messages": [{"role": "user", "content": "hi"}]}).orderBy("record_id").collect()
    assert full.label == "full" and full.final_answer == "done" and full.coverage["call_result_pairing"] == "observed"
    assert silent.label == "full" and silent.coverage["tool_results"] == "unavailable" and silent.final_answer == "hi"
    assert asked.label == "none" and asked.final_answer is None


def test_sample_traces(spark):
    listed = one(spark, {"id": "s", "actual_output": "o", "actual_trace": {"tool_calls": [], "retrieved_contexts": ["d"]}})
    assert listed.label == "full" and listed.coverage["retrieved_contexts"] == "observed" and listed.source_id == "s"
    assert one(spark, {"actual_trace": {}, "actual_output": "o"}).label == "answer_only"


@pytest.mark.parametrize(
    ("calls", "pairing", "arguments", "grouping"),
    [
        ([], "unavailable", "unavailable", "unavailable"),
        ([{"query": {"a": 1}, "result": "x"}], "inferred", "observed", "unavailable"),
        ([{"query": {}, "result": "x"}, {"query": {}, "result": "x"}], "unavailable", "observed", "unavailable"),
        ([{"query": {}, "result": "x"}, {"query": {}, "result": "y"}], "inferred", "observed", "unavailable"),
        ([{"query": "{'a': 1}", "result": "x", "step_number": 0, "tool_name": "t"}], "inferred", "unavailable", "observed"),
        ([{"query": {}, "result": "x", "step_number": 0}, {"query": {}, "result": "y", "step_number": 0}], "unavailable", "observed", "observed"),
        ([{"query": {}}], "unavailable", "observed", "unavailable"),
    ],
)
def test_rollouts_never_show_names(spark, calls, pairing, arguments, grouping):
    r = one(spark, {"question": "q", "final_answer": "<answer> 5\n</answer>", "tool_calls": calls, "reward": 0.5})
    assert (r.coverage["call_result_pairing"], r.coverage["tool_call_arguments"], r.coverage["parallel_grouping"], r.coverage["tool_call_names"]) == (pairing, arguments, grouping, "unavailable")
    assert r.final_answer == "5" and r.reward == 0.5


@pytest.mark.parametrize(
    ("action", "names"),
    [({"name": "a", "arguments": {}}, "observed"), ({}, "observed"), ({"stage": 1}, "observed"), ({"arguments": {}}, "unavailable"), ({"tool_calls": [{"function": {"name": ""}}]}, "unavailable"), ({"tool_name": "t"}, "observed"), ({"type": "function"}, "unavailable"), ({"type": "text"}, "observed")],
)
def test_actions_that_hide_a_call_hide_its_name(spark, action, names):
    step = one(spark, {"steps": [{"action": action}], "final_response": "x"})
    log = one(spark, {"events": [{"kind": "tool_call", "payload": {"action": action}}]})
    assert (step.coverage["tool_call_names"], log.coverage["tool_call_names"]) == (names, names)


def log(*events):
    return {"id": "L", "events": [{"kind": k, "payload": p} for k, p in events]}


def test_event_logs_count_turns_and_pair_results(spark):
    act, end = ("EventKind.TOOL_CALL", {"action": {"name": "a", "arguments": {}}}), ("TURN_COMPLETE", {})
    cases = [
        (log(act, ("tool_result", {"output": "r"}), end, act, end), "inferred", ["0", "0", "0", "1", "1"]),
        (log(act, act, ("tool_result", {"output": "r"}), end), "unavailable", ["0", "0", "0", "0"]),
        (log(act, ("tool_result", {"output": "r"})), "unavailable", [None, None]),
        (log(("tool_call", {"action": {"tool_calls": [{"id": "x", "name": "a"}, {"id": "y", "name": "b"}]}}), ("tool_result", {"tool_call_id": "y"}), ("tool_result", {"call_id": "x"})), "observed", [None] * 4),
    ]
    found = read(spark, *(c for c, *_ in cases))
    assert [r.coverage["call_result_pairing"] for r in found.orderBy("record_id").collect()] == [p for _, p, _ in cases]
    turns = {}
    for r in R.events(found).orderBy("record_id", "idx").collect():
        turns.setdefault(r.record_id, []).append(r.turn)
    assert list(turns.values()) == [t for *_, t in cases]
    scored = one(spark, log(("text", {"text": "x <answer>y</answer>"}), ("reward", {"scope": "step", "value": 3}), ("reward", {"scope": "episode", "value": 0.5})))
    assert (scored.final_answer, scored.reward) == ("y", 0.5)


def test_reports_become_rows(spark):
    rows = read(spark, {"model": "m", "samples": [{"idx": 1, "output": "a", "tool_calls": ["x", "y"], "passed": True}, {"idx": 2, "output": "", "error": "boom"}]}).orderBy("part").collect()
    assert [(r.part, r.source_id, r.label, r.final_answer, r.verdict) for r in rows] == [(0, "1", "tool_names_only", "a", True), (1, "2", "none", None, None)]


def test_import_and_rebuild_give_the_messages_back(spark):
    rng = random.Random(5)
    chats = [CHAT]
    for _ in range(30):
        chat = []
        for _ in range(rng.randrange(12)):
            calls = [call(rng.choice("ab"), str(rng.random())) for _ in range(rng.randrange(1, 4))]
            chat.append(rng.choice([{"role": "user", "content": "u"}, {"role": "assistant", "content": "t"}, {"role": "assistant", "tool_calls": calls}, {"role": "tool", "tool_call_id": "1", "content": "r"}]))
        chats.append(chat)
    back = {}
    for r in R.rebuild(R.events(read(spark, *({"messages": c} for c in chats))), observations=True).orderBy("record_id", "message_no").collect():
        back.setdefault(int(r.record_id), []).append((r.role, None if r.tool_calls else r.content, [json.loads(c) for c in r.tool_calls], r.tool_call_id))
    for k, chat in enumerate(chats):
        assert back.get(k, []) == [(m["role"], None if m.get("tool_calls") else m["content"], m.get("tool_calls", []), m.get("tool_call_id")) for m in chat]


def test_turn_names_that_come_again_are_turns_of_their_own(spark):
    flat = [("r", 0, k, "assistant", "tool_call", f'{{"name": "{k}"}}', None, turn, named) for k, (turn, named) in enumerate([("1", True), ("1", True), ("2", True), ("1", True), (None, True), ("1", False), (None, True)])]
    rows = spark.createDataFrame(flat, "record_id string, part int, idx int, role string, type string, payload string, call_id string, turn string, callable boolean")
    assert [len(r.tool_calls) for r in R.rebuild(rows).orderBy("message_no").collect()] == [2, 1, 1, 2]


def test_unnamed_calls_are_told_from_no_calls(spark):
    found = read(spark, {"question": "q", "final_answer": "a", "tool_calls": [{"query": {}}]}, {"question": "q", "final_answer": "a", "tool_calls": []}, log(("tool_call", {"action": {}})))
    assert [(r.n_calls, r.unnamed) for r in R.turns(found).orderBy("record_id").collect()] == [(0, True), (0, False), (0, False)]


def test_census_names_what_can_be_scored(spark):
    rows = {(r.shape, r.label): (r.n, r.tasks, r.scorers) for r in R.census(read(spark, {"messages": CHAT}, {"prompt": "p"}, "{", {"question": "q", "final_answer": "a", "retrieved_chunk_ids": ["d"]})).collect()}
    assert rows["task", "none"] == (1, 1, []) and rows["unknown", "none"] == (1, 0, []) and rows["rollout", "answer_only"][2] == ["retrieval", "task_completion"]
    assert "parallel_tool_calls" in rows["messages", "full"][2]


def plain_depth(text):
    depth = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            inside, escaped = (escaped or c != '"'), (not escaped and c == "\\")
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def test_json_depth_equals_a_walk(spark):
    rng = random.Random(2)
    texts = ["", '{"a": "[[["}', '"\\"[" [', '["\\\\"]', '"', '"\\', "]][[", '{"é": ["😀", {}]}'] + ["".join(rng.choice('[]{}"\\a,') for _ in range(rng.randrange(30))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", structured.json_depth("t").alias("d")).collect()
    assert {r.k: r.d for r in got} == {k: plain_depth(t) for k, t in enumerate(texts)}


def test_brackets_that_never_close_are_refused_at_once(spark):
    df = spark.createDataFrame([("[" * 20_000,), ('{"a":' * 20_000,), ('"' + "[" * 500_000,)], "t string")
    df.select(structured.json_refused("t")).collect()
    began = time.perf_counter()
    assert [r[0] for r in df.select(structured.json_refused(F.concat("t", F.lit(" ")))).collect()] == [True, True, False]
    assert time.perf_counter() - began < 1.5
