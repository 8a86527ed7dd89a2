"""Recorded agent runs in mixed JSON shapes: one table of records becomes one table of episodes and one of events.

A record is read once, as a VARIANT. Its shape is decided by the keys it has, record by record, so a file may mix them;
its events are built inside its row. Shapes:

* `messages`: chat messages, as a list or under `messages`; calls of one message share a turn;
* `sample`: `actual_trace` with messages, or with calls by turn;
* `event_log`: `events` with kinds, payloads and `turn_complete` marks;
* `rollout`: a question with `final_answer` and calls that carry a query and a step's result, but no scorable name;
* `trajectory`: `steps` of thought, action and observation;
* `report_row`: a row of a run's report, with names of tools alone; a whole report (`samples`) becomes its rows;
* `task`: a prompt to run, nothing recorded.

Anything else stays as a row of shape `unknown` with the reason. What a record shows is its coverage: for each part
`observed`, `inferred` or `unavailable`; zero calls in a full transcript are an observation, a missing one is not.

rebuild() goes the other way: from flat events back to messages, by one ordered pass over each record's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.structured import MAX_DEPTH, json_refused
from verdictframe.operators.reports import supported_scorers

PARTS = ["final_answer", "tool_call_names", "tool_call_arguments", "tool_results", "call_result_pairing", "parallel_grouping", "retrieved_contexts"]
SHAPES = ["messages", "sample", "event_log", "rollout", "trajectory", "report_row", "task", "unknown"]
OBSERVED, INFERRED, UNAVAILABLE = "observed", "inferred", "unavailable"
#: Keys by which a record that is no known call still shows that one was made, and keys of a bare call.
CALL_MARKS = ["name", "tool_name", "arguments", "parameters", "args", "input", "query"]
CALL_KEYS = ["name", "arguments", "args", "parameters", "input", "id", "type", "function", "tool_name", "tool_call_id"]
REPORT_KEYS = ["idx", "output", "passed", "scores", "n_tools", "tool_calls", "error"]
EVENT = "struct<role:string,type:string,name:string,payload:string,call_id:string,turn:string,callable:boolean,arguments:boolean,unnamed:boolean>"
_NO_EVENTS = f"array<{EVENT}>"


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str = "$") -> Column:
    """A value as text; objects and lists as JSON; null where it is missing or null."""
    return F.try_variant_get(v, path, "string")


def _keys(v: Column, path: str = "$") -> Column:
    """The keys of an object; an empty list for anything else."""
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<string>"))


def _is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def _has(keys: Column, *names: str) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, names)))


def _filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.when(t != "", t) for t in texts))


def _none() -> Column:
    return F.array().cast(_NO_EVENTS)


def _all_of(v: Column | None) -> Column:
    return F.coalesce(v, F.array().cast("array<variant>"))


def _event(role, kind, name=None, payload=None, call_id=None, turn=None, callable_=False, arguments=False, unnamed=False) -> Column:
    def c(x, type_="string"):
        return (x if isinstance(x, Column) else F.lit(x)).cast(type_)

    return F.struct(c(role).alias("role"), c(kind).alias("type"), c(name).alias("name"), c(payload).alias("payload"), c(call_id).alias("call_id"), c(turn).alias("turn"), c(callable_, "boolean").alias("callable"), c(arguments, "boolean").alias("arguments"), c(unnamed, "boolean").alias("unnamed"))


def _callable(c: Column) -> Column:
    """Whether an object is a call by its shape."""
    keys = _keys(c)
    bare = F.size(F.array_except(keys, F.array(*map(F.lit, CALL_KEYS)))) == 0
    return _has(keys, "name", "function") | (_has(keys, "tool_name") & (_has(keys, "parameters") | bare))


def _unnamed(c: Column) -> Column:
    """Whether an object shows that a call was made, but not of which tool."""
    explicit = _filled(_text(c, "$.name"), _text(c, "$.tool_name"), _text(c, "$.function.name"))
    typed = F.coalesce(_text(c, "$.type") == "function", F.lit(False)) | F.coalesce(_text(c, "$.function.type") == "function", F.lit(False))
    return explicit.isNull() & (_has(_keys(c), *CALL_MARKS) | _has(_keys(c, "$.function"), *CALL_MARKS) | typed)


def _call(c: Column, turn: Column | None, name: bool = True) -> Column:
    """The event of a recorded call in any of its spellings."""
    keys, inner = _keys(c), _keys(c, "$.function")
    named = _filled(_text(c, "$.name"), _text(c, "$.tool_name"), _text(c, "$.function.name"), F.when(~_is_object(c, "$.function"), _text(c, "$.function")))
    arguments = F.when(_is_object(c, "$.function"), _has(inner, "arguments", "parameters")).otherwise(_has(keys, "arguments", "parameters"))
    return _event("assistant", "tool_call", named if name else None, F.to_json(c), _filled(_text(c, "$.id"), _text(c, "$.tool_call_id")), turn, _callable(c) if name else False, arguments, _unnamed(c))


def _action_calls(a: Column) -> Column:
    """The calls of a step's action: its list, or itself if it is a call."""
    listed = _list(a, "$.tool_calls")
    return F.when(listed.isNotNull(), F.filter(listed, lambda c: _is_object(c))).when(_callable(a), F.array(a)).otherwise(F.array().cast("array<variant>"))


def _of_action(a: Column, turn: Column | None) -> Column:
    """Events of an action's calls; an action without any, which still may hide one, is an event that is no call."""
    calls = _action_calls(a)
    silent = _call(a, turn).withField("callable", F.lit(False)).withField("name", F.lit(None).cast("string"))
    return F.when(F.size(calls) > 0, F.transform(calls, lambda c: _call(c, turn))).otherwise(F.array(silent))


def _of_messages(ms: Column) -> Column:
    def one(m: Column, i: Column) -> Column:
        role, calls, content = _text(m, "$.role"), _list(m, "$.tool_calls"), _text(m, "$.content")
        return (
            F.when((role == "assistant") & (F.size(calls) > 0), F.transform(calls, lambda c: _call(c, i)))
            .when(role == "tool", F.array(_event("tool", "tool_result", None, content, _text(m, "$.tool_call_id"), i)))
            .when((role == "assistant") & (content != ""), F.array(_event("assistant", "text", None, content, None, i)))
            .when(role.isin("user", "system"), F.array(_event(role, "observation", None, content, None, i)))
            .otherwise(_none())
        )

    return F.flatten(F.transform(_all_of(ms), one))


def _retrieved(listed: Column) -> Column:
    return F.when(F.size(listed) > 0, F.array(_event("environment", "observation", "retrieved_contexts", F.to_json(F.transform(listed, lambda c: _text(c)))))).otherwise(_none())


def _of_turns(turns: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        return F.transform(F.coalesce(_list(t), F.array(t)), lambda c: _call(c, i))

    return F.flatten(F.transform(_all_of(turns), one))


def _of_rollout(v: Column) -> Column:
    calls = _all_of(_list(v, "$.tool_calls"))
    grouped = F.forall(calls, lambda c: _has(_keys(c), "step_number"))

    def one(c: Column, i: Column) -> Column:
        turn = F.when(grouped, _text(c, "$.step_number")).otherwise(i.cast("string"))
        call = F.array(_call(c, turn, name=False))
        return F.when(_has(_keys(c), "result"), F.concat(call, F.array(_event("tool", "tool_result", None, _text(c, "$.result"), None, turn)))).otherwise(call)

    return F.concat(F.flatten(F.transform(calls, one)), _retrieved(_list(v, "$.retrieved_chunk_ids")))


def _of_steps(v: Column) -> Column:
    def one(s: Column, i: Column) -> Column:
        turn, thought, seen = F.coalesce(_text(s, "$.step_number"), i.cast("string")), _text(s, "$.thought"), _text(s, "$.observation")
        return F.concat(
            F.when(thought != "", F.array(_event("assistant", "reasoning", None, thought, None, turn))).otherwise(_none()),
            F.transform(_action_calls(F.try_variant_get(s, "$.action", "variant")), lambda c: _call(c, turn)),
            F.when(seen.isNotNull(), F.array(_event("tool", "tool_result", None, seen, None, turn))).otherwise(_none()),
        )

    steps = F.filter(_all_of(_list(v, "$.steps")), lambda s: _is_object(s))
    return F.concat(F.flatten(F.transform(steps, one)), _retrieved(_list(v, "$.metadata.retrieved_chunk_ids")))


def _of_log(v: Column) -> Column:
    def one(e: Column) -> Column:
        kind = F.lower(F.substring_index(F.coalesce(_text(e, "$.kind"), F.lit("")), ".", -1))
        payload, text = _text(e, "$.payload"), _text(e, "$.payload.text")
        return (
            F.when(kind == "tool_call", _of_action(F.coalesce(F.try_variant_get(e, "$.payload.action", "variant"), F.parse_json(F.lit("{}"))), None))
            .when(kind == "tool_result", F.array(_event("tool", kind, None, F.coalesce(_text(e, "$.payload.output"), payload), _filled(_text(e, "$.payload.tool_call_id"), _text(e, "$.payload.call_id")))))
            .when(kind.isin("text", "reasoning"), F.array(_event("assistant", kind, None, text)))
            .when(kind == "observation", F.array(_event("user", kind, None, F.coalesce(text, payload))))
            .otherwise(F.array(_event("environment", kind, _text(e, "$.payload.scope"), F.coalesce(_text(e, "$.payload.value"), payload))))
        )

    return F.flatten(F.transform(_all_of(_list(v, "$.events")), one))


def _of_names(v: Column) -> Column:
    return F.transform(_all_of(_list(v, "$.tool_calls")), lambda n, i: _event("assistant", "tool_call", _text(n), F.to_json(F.struct(_text(n).alias("name"))), None, i, True))


def _shape(v: Column, keys: Column) -> Column:
    chat = F.exists(_all_of(_list(v)), lambda m: _is_object(m) & _has(_keys(m), "role"))
    return (
        F.when(_list(v, "$.events").isNotNull(), "event_log")
        .when(_list(v, "$.messages").isNotNull() | chat, "messages")
        .when(_is_object(v, "$.actual_trace"), "sample")
        .when(_has(keys, "question") & _has(keys, "final_answer"), "rollout")
        .when(_has(keys, "steps", "trajectory_id", "final_response"), "trajectory")
        .when(_has(keys, "prompt"), "task")
        .when(_has(keys, *REPORT_KEYS), "report_row")
        .otherwise("unknown")
    )


def _shown(condition: Column) -> Column:
    return F.when(condition, OBSERVED).otherwise(UNAVAILABLE)


def episodes(records: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """Per record: record_id, part (of a report; else 0), shape, reason, source_id, final_answer, reward, verdict, events, coverage.

    records has an id of its own for each record, and its JSON as text. The rows of a report are parts of its record.
    """
    read = records.select(F.col(f"`{record_id}`").alias("record_id"), F.col(f"`{record}`").alias("text")).withColumn("deep", json_refused("text"))
    read = read.withColumn("whole", F.try_parse_json(F.when(~F.col("deep"), F.col("text"))))
    rows = F.coalesce(F.when(_list(F.col("whole"), "$.samples").isNotNull() & ~_has(_keys(F.col("whole")), "events"), _list(F.col("whole"), "$.samples")), F.array("whole"))
    v = F.col("v")
    each = read.select("record_id", "deep", F.col("whole").isNull().alias("unreadable"), F.posexplode(rows).alias("part", "v")).withColumn("keys", _keys(v))
    shaped = each.withColumn("shape", _shape(v, F.col("keys")))
    shape = F.col("shape")
    reason = F.when(F.col("deep"), f"nested deeper than {MAX_DEPTH} levels").when(F.col("unreadable"), "no JSON").when(shape != "unknown", None).when(F.size("keys") > 0, F.concat(F.lit("no known shape has the keys "), F.array_join(F.slice(F.array_sort("keys"), 1, 5), ", "))).otherwise("neither an object nor a list of messages")

    transcript = F.coalesce(_list(v, "$.messages"), _list(v, "$.actual_trace.messages"), F.when(shape == "messages", _list(v)))
    has_transcript = F.coalesce(F.size(transcript), F.lit(0)) > 0
    retrieved = F.coalesce(_list(v, "$.retrieved_contexts"), _list(v, "$.actual_trace.retrieved_contexts"))
    turns = _list(v, "$.actual_trace.tool_calls")
    events = (
        F.when(shape == "messages", F.concat(_of_messages(transcript), _retrieved(retrieved)))
        .when(shape == "sample", F.concat(F.when(has_transcript, _of_messages(transcript)).otherwise(_of_turns(turns)), _retrieved(retrieved)))
        .when(shape == "rollout", _of_rollout(v))
        .when(shape == "trajectory", _of_steps(v))
        .when(shape == "event_log", _of_log(v))
        .when(shape == "report_row", _of_names(v))
        .otherwise(_none())
    )
    spoken = F.filter(_all_of(transcript), lambda m: (_text(m, "$.role") == "assistant") & (F.coalesce(F.size(_list(m, "$.tool_calls")), F.lit(0)) <= 0))
    built = shaped.withColumn("events", events).withColumn("said", _text(F.try_element_at(spoken, F.lit(-1)), "$.content"))
    last_text = F.try_element_at(F.filter("events", lambda e: e["type"] == "text"), F.lit(-1))["payload"]
    answer = (
        F.when(shape.isin("messages", "sample"), F.coalesce(_text(v, "$.actual_output"), _text(v, "$.final_answer"), F.col("said")))
        .when(shape == "rollout", _answer(_text(v, "$.final_answer")))
        .when(shape == "trajectory", _answer(F.coalesce(_text(v, "$.final_response"), _text(v, "$.final_answer"))))
        .when(shape == "event_log", _answer(last_text))
        .when(shape == "report_row", F.when(F.coalesce(_text(v, "$.error"), F.lit("")) == "", _text(v, "$.output")))
    )
    source = F.when(shape == "report_row", _text(v, "$.idx")).when(shape == "task", _text(v, "$.question_id")).when(shape.isin("rollout", "trajectory"), _text(v, "$.trajectory_id")).otherwise(_text(v, "$.id"))
    reward = F.when(
        shape == "event_log", F.try_element_at(F.filter("events", lambda e: (e["type"] == "reward") & (e["name"] == "episode")), F.lit(-1))["payload"].try_cast("double")
    ).otherwise(F.try_variant_get(v, "$.reward", "double"))
    found = built.withColumn("final_answer", answer)
    return found.select(
        "record_id", "part", "shape", reason.alias("reason"), source.alias("source_id"), "final_answer", reward.alias("reward"), F.try_variant_get(v, "$.passed", "boolean").alias("verdict"), "events", _coverage(v, transcript, turns).alias("coverage")
    ).withColumn("label", label(F.col("coverage")))


def _answer(text: Column) -> Column:
    """The text inside the first <answer> tag, else the whole text, trimmed."""
    tag = r"(?is)<answer>(.*?)</answer>"
    return F.regexp_replace(F.when(text.rlike(tag), F.regexp_extract(text, tag, 1)).otherwise(text), r"^\s+|\s+$", "")


def _coverage(v: Column, transcript: Column, turns: Column) -> Column:
    """A map of PARTS to what the record shows of them; from the columns shape, events and final_answer."""
    shape, events = F.col("shape"), F.col("events")

    def of(kind: str) -> Column:
        return F.filter(events, lambda e: e["type"] == kind)

    calls, results = of("tool_call"), of("tool_result")
    any_call, any_result = F.size(calls) > 0, F.size(results) > 0
    any_arguments, any_unnamed = F.exists(calls, lambda e: e["arguments"]), F.exists(calls, lambda e: e["unnamed"])
    chat = shape.isin("messages", "sample")
    assistant = F.exists(_all_of(transcript), lambda m: _text(m, "$.role") == "assistant")
    seen = any_call | F.coalesce(assistant, F.lit(False)) | ((F.coalesce(F.size(transcript), F.lit(0)) <= 0) & turns.isNotNull())
    steps = _all_of(_list(v, "$.steps"))
    acted = F.exists(steps, lambda s: _has(_keys(s), "action"))
    # an action that is no call may hide one without a name
    hidden = F.exists(steps, lambda s: F.coalesce((F.size(_action_calls(F.try_variant_get(s, "$.action", "variant"))) == 0) & _unnamed(F.try_variant_get(s, "$.action", "variant")), F.lit(False)))

    listed = _all_of(_list(v, "$.tool_calls"))
    given = F.transform(F.filter(listed, lambda c: _has(_keys(c), "result")), lambda c: F.coalesce(_text(c, "$.result"), F.lit("null")))
    stepped = (F.size(listed) > 0) & F.forall(listed, lambda c: _has(_keys(c), "step_number"))
    numbers = F.transform(listed, lambda c: _text(c, "$.step_number"))
    copied = (F.size(F.array_distinct(given)) < F.size(given)) | (stepped & (F.size(F.array_distinct(numbers)) < F.size(numbers)))

    marks = F.transform(F.filter(events, lambda e: (e["type"] == "turn_complete") | ((e["type"] == "tool_call") & e["callable"])), lambda e: e["type"] == "turn_complete")
    bounded = F.exists(marks, lambda m: m)
    real = F.exists(marks, lambda m: ~m)
    alone = ~F.exists(F.zip_with(marks, F.concat(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), F.array(F.lit(True))), lambda a, b: ~a & ~b), lambda twice: twice)
    ids = lambda es: F.transform(es, lambda e: e["call_id"])
    named = any_result & ~F.exists(ids(results), lambda i: i.isNull()) & (F.size(F.array_except(ids(results), ids(calls))) == 0)

    def by_shape(default: Column, **others: Column) -> Column:
        out = F.when(chat, default)
        for name, what in others.items():
            out = out.when(shape == name, what)
        return out.otherwise(UNAVAILABLE)

    no = F.lit(UNAVAILABLE)
    # blocked at the source: an errored row's text is no answer
    parts = {
        "final_answer": F.when(shape.isin("task", "unknown"), no).otherwise(_shown(F.col("final_answer").isNotNull())),
        "tool_call_names": by_shape(_shown(seen), event_log=_shown(any_call & ~any_unnamed), trajectory=_shown((any_call | acted) & ~any_unnamed & ~hidden), report_row=_shown(any_call)),
        "tool_call_arguments": by_shape(_shown(seen), event_log=_shown(any_arguments), trajectory=_shown(any_arguments), rollout=_shown((F.size(listed) > 0) & F.forall(listed, lambda c: _is_object(c, "$.query")))),
        "tool_results": F.when(shape.isin("task", "unknown", "report_row"), no).otherwise(_shown(any_result)),
        "call_result_pairing": by_shape(
            _shown(any_result),
            event_log=F.when(named, OBSERVED).when(any_result & bounded & real & alone, INFERRED).otherwise(UNAVAILABLE),
            trajectory=_shown(F.coalesce(F.size(_list(v, "$.metadata.conversation")), F.lit(0)) > 0),
            rollout=F.when((F.size(given) == 0) | copied, UNAVAILABLE).otherwise(INFERRED),
        ),
        "parallel_grouping": by_shape(_shown(seen), event_log=_shown(bounded & real), trajectory=_shown(any_call), rollout=_shown(stepped)),
        "retrieved_contexts": _shown(F.exists(events, lambda e: F.coalesce(e["name"] == "retrieved_contexts", F.lit(False)))),
    }
    return F.create_map(*(x for name in PARTS for x in (F.lit(name), parts[name])))


def label(coverage: Column) -> Column:
    """One word for a coverage map: full, tool_names_only, answer_only or none."""
    seen = lambda part: F.coalesce(F.try_element_at(coverage, F.lit(part)) == OBSERVED, F.lit(False))
    return F.when(seen("tool_call_arguments"), "full").when(seen("tool_call_names"), "tool_names_only").when(seen("final_answer"), "answer_only").otherwise("none")


def events(found: DataFrame) -> DataFrame:
    """The events of episodes(), a row each: record_id, part, shape, idx, role, type, name, payload, call_id, turn, callable.

    Turns of an event log are counted by the marks before an event, and null where the log has none.
    """
    rows = found.select("record_id", "part", "shape", F.posexplode("events").alias("idx", "e")).select("record_id", "part", "shape", "idx", "e.role", "e.type", "e.name", "e.payload", "e.call_id", "e.turn", "e.callable")
    own = Window.partitionBy("record_id", "part")
    ends = F.sum((F.col("type") == "turn_complete").cast("int"))
    before = F.coalesce(ends.over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = F.when(ends.over(own) > 0, before.cast("string"))
    return rows.withColumn("turn", F.when(F.col("shape") == "event_log", counted).otherwise(F.col("turn")))


def census(found: DataFrame) -> DataFrame:
    """shape, label, n, tasks and the scorers that some record of the group can feed, of episodes()."""
    each = found.withColumn("scorers", F.when(~F.col("shape").isin("task", "unknown"), supported_scorers(F.col("coverage"))).otherwise(F.array().cast("array<string>")))
    return each.groupBy("shape", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("shape") == "task").alias("tasks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("scorers")))).alias("scorers"))


def rebuild(rows: DataFrame, observations: bool = False) -> DataFrame:
    """Messages of flat events(): record_id, part, message_no, role, content, tool_calls (JSON texts), tool_call_id.

    Calls that follow each other in one turn are one message, also where the same turn's name comes again later; events
    that are no calls by shape are passed over and part no group. observations adds what users and systems said.
    """
    said = F.col("type").isin("text", "reasoning") & (F.col("payload") != "")
    heard = (F.col("type") == "observation") & F.col("role").isin("user", "system") if observations else F.lit(False)
    kept = rows.withColumn("is_call", (F.col("type") == "tool_call") & F.col("callable")).where((F.col("is_call") | (F.col("type") == "tool_result") | said | heard) | ~F.col("type").isin("tool_call"))
    order = Window.partitionBy("record_id", "part").orderBy("idx")
    joins = F.col("is_call") & F.coalesce(F.lag("is_call").over(order), F.lit(False)) & F.col("turn").eqNullSafe(F.lag("turn").over(order))
    numbered = kept.withColumn("run", F.sum((~joins).cast("int")).over(order))
    shown = numbered.where(F.col("is_call") | (F.col("type") == "tool_result") | said | heard)
    calls = F.array_sort(F.collect_list(F.when(F.col("is_call"), F.struct("idx", "payload"))))
    grouped = shown.groupBy("record_id", "part", "run").agg(F.first("role").alias("role"), F.first(F.when(~F.col("is_call"), F.col("payload"))).alias("content"), calls.alias("calls"), F.first(F.when(F.col("type") == "tool_result", F.col("call_id"))).alias("tool_call_id"))
    number = F.row_number().over(Window.partitionBy("record_id", "part").orderBy("run")) - 1
    return grouped.select("record_id", "part", number.alias("message_no"), "role", "content", F.transform("calls", lambda c: c["payload"]).alias("tool_calls"), "tool_call_id")


def turns(found: DataFrame) -> DataFrame:
    """Per record: record_id, part, n_turns, n_calls and unnamed (calls were recorded, but none can be scored and no names were seen)."""
    rows = events(found).where("type = 'tool_call'")
    order = Window.partitionBy("record_id", "part").orderBy("idx")
    fresh = ~(F.col("turn").isNotNull() & F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False)))
    called = rows.where("callable").withColumn("fresh", fresh)
    counted = called.groupBy("record_id", "part").agg(F.count_if("fresh").alias("n_turns"), F.count(F.lit(1)).alias("n_calls"))
    anything = F.exists("events", lambda e: e["type"] == "tool_call")
    unseen = F.coalesce(F.try_element_at("coverage", F.lit("tool_call_names")) != OBSERVED, F.lit(True))
    joined = found.select("record_id", "part", (anything & unseen).alias("hides")).join(counted, ["record_id", "part"], "left")
    none = F.lit(0).cast("long")
    return joined.select("record_id", "part", F.coalesce("n_turns", none).alias("n_turns"), F.coalesce("n_calls", none).alias("n_calls"), (F.col("hides") & F.col("n_calls").isNull()).alias("unnamed"))
