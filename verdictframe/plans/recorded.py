"""Recorded agent runs: the event log as JSON records of mixed shapes, imported, counted and turned back into messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions import matching, structured
from verdictframe.operators import rag
from verdictframe.operators import reports as O  # noqa: N812
from verdictframe.plans.registry import query, table
from verdictframe.sources import recorded as R

_CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"


def records(spark, sf_dir):
    """A record a user; the user's events are the calls, and the id decides which of seven shapes they are written in."""
    e = table(spark, sf_dir, "events")
    daily = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props", F.col("value").cast("string").alias("value")))).alias("calls"))
    by_user = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "calls"))).alias("days"))
    each = by_user.withColumn("calls", F.flatten(F.transform("days", lambda d: d["calls"])))
    user, calls = F.col("user_id").cast("string"), F.col("calls")

    def named(c: Column) -> Column:
        return F.struct(c["event_type"].alias("name"), F.parse_json(c["props"]).alias("arguments"))

    def message(role: str, content: Column | None = None, made: Column | None = None, answers: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), (F.lit(None) if content is None else content).cast("string").alias("content"), (F.lit(None) if made is None else made).cast(f"array<{_CALL}>").alias("tool_calls"), (F.lit(None) if answers is None else answers).cast("string").alias("tool_call_id"))

    def id_of(c: Column) -> Column:
        return F.concat(F.lit("call_"), c["event_id"].cast("string"))

    def asked(c: Column) -> Column:
        made = F.struct(id_of(c).alias("id"), F.lit("function").alias("type"), F.struct(c["event_type"].alias("name"), c["props"].alias("arguments")).alias("function"))
        return F.array(message("assistant", made=F.array(made)), message("tool", c["value"], answers=id_of(c)))

    def logged(c: Column) -> Column:
        def event(kind: str, action: Column | None = None, output: Column | None = None) -> Column:
            payload = F.struct((F.lit(None) if action is None else action).cast("struct<name:string,arguments:variant>").alias("action"), (F.lit(None) if output is None else output).cast("string").alias("output"))
            return F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))

        return F.array(event("EventKind.TOOL_CALL", named(c)), event("tool_result", output=c["value"]), event("turn_complete"))

    chat = F.concat(F.array(message("user", F.lit("go on"))), F.flatten(F.transform(calls, asked)), F.array(message("assistant", F.lit("done"))))
    shapes = [
        F.struct(chat.alias("messages")),
        F.struct(F.lit("done").alias("actual_output"), F.struct(F.transform("days", lambda d: F.transform(d["calls"], named)).alias("tool_calls")).alias("actual_trace")),
        F.struct(user.alias("trajectory_id"), F.lit("<answer> done </answer>").alias("final_response"), F.transform(calls, lambda c, i: F.struct(i.alias("step_number"), c["event_type"].alias("thought"), F.struct(F.array(named(c)).alias("tool_calls")).alias("action"), c["value"].alias("observation"))).alias("steps")),
        F.struct(F.lit("what?").alias("question"), F.lit("done").alias("final_answer"), F.transform(calls, lambda c: F.struct(F.parse_json(c["props"]).alias("query"), F.concat(c["value"], F.lit(" of "), c["event_id"].cast("string")).alias("result"))).alias("tool_calls")),
        F.struct(user.alias("idx"), F.lit("done").alias("output"), F.transform(calls, lambda c: c["event_type"]).alias("tool_calls")),
        F.struct(F.lit("do it").alias("prompt"), user.alias("question_id")),
        F.struct(user.alias("id"), F.flatten(F.transform(calls, logged)).alias("events")),
        F.struct(user.alias("nothing")),
    ]
    written = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        written = F.when(F.col("user_id") % len(shapes) == k, F.to_json(shape)).otherwise(written)
    return each.select(F.col("user_id").alias("record_id"), written.alias("record"))


_USERS = "WITH u AS (SELECT user_id AS record_id, CAST(user_id % 8 AS INTEGER) AS k, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)"
_SHAPE = "(['messages', 'sample', 'trajectory', 'rollout', 'report_row', 'task', 'event_log', 'unknown'])[k + 1]"
# a rollout shows the arguments of calls whose names it lacks
_LABEL = "(['full', 'full', 'full', 'full', 'tool_names_only', 'none', 'full', 'none'])[k + 1]"


@query(
    _USERS
    + f""" SELECT record_id, {_SHAPE} AS shape, {_LABEL} AS label, CASE WHEN k IN (0, 1, 2, 3, 4) THEN 'done' END AS final_answer, CAST(CASE k WHEN 0 THEN 2 * n + 2 WHEN 1 THEN n WHEN 2 THEN 3 * n WHEN 3 THEN 2 * n WHEN 4 THEN n WHEN 6 THEN 3 * n ELSE 0 END AS BIGINT) AS n_events,
 CASE WHEN k = 0 THEN 'observed' WHEN k IN (3, 6) THEN 'inferred' ELSE 'unavailable' END AS pairing, CASE WHEN k = 7 THEN 'no known shape has the keys nothing' END AS reason FROM u"""
)
def src15_import_mixed(spark, sf_dir):
    """One table of records in seven shapes, and some in none, as episodes."""
    found = R.episodes(records(spark, sf_dir))
    return found.select("record_id", "shape", "label", "final_answer", F.size("events").cast("long").alias("n_events"), F.col("coverage")["call_result_pairing"].alias("pairing"), "reason")


@query(
    "WITH e AS (SELECT user_id AS record_id, user_id % 8 AS k, event_type AS name, CAST(ts AS DATE) AS day FROM events) SELECT record_id, name, count(*) AS n_calls FROM e WHERE k IN (0, 1, 2, 4, 6) GROUP BY 1, 2"
)
def src08_imported_calls(spark, sf_dir):
    """How often each record's agent called each tool, from the one event table of all shapes."""
    rows = R.events(R.episodes(records(spark, sf_dir)))
    return rows.where("type = 'tool_call' and callable").groupBy("record_id", "name").agg(F.count(F.lit(1)).alias("n_calls"))


_FULL = "parallel_tool_calls,redundant_tool_calls,task_completion,tool_call_f1,tool_call_validity,trajectory_match"


@query(
    _USERS
    + f""" SELECT {_SHAPE} AS shape, {_LABEL} AS label, count(*) AS n, CAST(sum(CASE WHEN k = 5 THEN 1 ELSE 0 END) AS BIGINT) AS tasks,
 CASE WHEN k IN (0, 1, 2, 6) THEN '{_FULL}' WHEN k = 3 THEN 'task_completion' WHEN k = 4 THEN 'task_completion,tool_call_f1_name,tool_call_validity' ELSE '' END AS scorers FROM u GROUP BY k"""
)
def src16_census(spark, sf_dir):
    """Shapes, coverage labels and eligible scorers of a table of records."""
    return R.census(R.episodes(records(spark, sf_dir))).withColumn("scorers", F.array_join("scorers", ","))


@query(
    _USERS
    + """ SELECT record_id, CAST(CASE k WHEN 0 THEN 2 * n + 1 WHEN 1 THEN days WHEN 2 THEN 3 * n WHEN 3 THEN n WHEN 4 THEN n ELSE 2 * n END AS BIGINT) AS n_messages, CAST(CASE WHEN k IN (1) THEN n WHEN k = 3 THEN 0 ELSE n END AS BIGINT) AS n_calls FROM u WHERE k NOT IN (5, 7)"""
)
def epi07_rebuilt_messages(spark, sf_dir):
    """The messages that flat events make up again: calls of one turn are one message."""
    rows = R.rebuild(R.events(R.episodes(records(spark, sf_dir))))
    return rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.size("tool_calls")).alias("n_calls"))


@query(_USERS + " SELECT record_id, CAST(CASE WHEN k IN (3, 5, 7) THEN 0 WHEN k = 1 THEN days ELSE n END AS BIGINT) AS n_turns, CAST(CASE WHEN k IN (3, 5, 7) THEN 0 ELSE n END AS BIGINT) AS n_calls, k = 3 AS unnamed FROM u")
def epi07_turns(spark, sf_dir):
    """Turns and scorable calls of each record, and whether its calls have no names."""
    return R.turns(R.episodes(records(spark, sf_dir))).drop("part")


@query(_USERS + f" SELECT {_LABEL} AS coverage, count(*) AS n FROM u GROUP BY 1")
def epi06_coverage_label(spark, sf_dir):
    """How many records are covered in full (arguments were seen), by tool names alone, by an answer alone, or not at all."""
    return R.episodes(records(spark, sf_dir)).groupBy(F.col("label").alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_id % 128 + 1 AS depth, event_id % 128 + 1 > 100 AS refused FROM events")
def fn01_json_depth(spark, sf_dir):
    """The nesting of each event's props in as many lists as its id says, told before any of it is parsed."""
    deep = F.col("event_id") % 128
    text = F.concat(F.repeat(F.lit("["), deep.cast("int")), F.col("props"), F.repeat(F.lit("]"), deep.cast("int")))
    return table(spark, sf_dir, "events").select("event_id", structured.json_depth(text).cast("long").alias("depth"), structured.json_refused(text).alias("refused"))


@query(
    _USERS
    + f""" SELECT record_id, CASE WHEN k IN (0, 1, 2, 6) THEN 'task_completion,tool_call_f1,trajectory_match,tool_call_validity,redundant_tool_calls,parallel_tool_calls'
 WHEN k = 4 THEN 'task_completion,tool_call_f1_name,tool_call_validity' ELSE 'task_completion' END AS scorers FROM u"""
)
def epi11_supported_scorers(spark, sf_dir):
    """Which scorers each record can feed, by what it was seen to cover."""
    found = R.episodes(records(spark, sf_dir))
    return found.select("record_id", F.array_join(O.supported_scorers(F.col("coverage")), ",").alias("scorers"))


@query(_USERS + " SELECT record_id FROM u WHERE k <> 5")
def flt11_recorded_only(spark, sf_dir):
    """The records that hold a run: tasks to run aren't scored."""
    found = R.episodes(records(spark, sf_dir)).withColumn("is_task", F.col("shape") == "task")
    return O.recorded_only(found).select("record_id")


@query(_USERS + " SELECT record_id, CASE WHEN k IN (3, 6) THEN 'inferred' WHEN k = 7 THEN 'missing' ELSE 'observed' END AS coverage FROM u")
def rst11_event_coverage(spark, sf_dir):
    """Whether a record's events were observed (none is an observation, too), inferred, or never captured."""
    found = R.episodes(records(spark, sf_dir))
    said = F.when(F.col("coverage")["call_result_pairing"] == R.INFERRED, R.INFERRED)
    listed = F.when(F.col("shape") != "unknown", F.transform("events", lambda e: e["type"]))
    return found.select("record_id", O.event_coverage(said, listed).alias("coverage"))


_TURNS = "SELECT conv_id, turn, text AS after, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user'"
_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


@query(
    f"WITH t AS ({_TURNS}), w AS (SELECT conv_id, turn, {_W.format('before')} AS b, {_W.format('after')} AS a FROM t WHERE before IS NOT NULL),"
    " d AS (SELECT *, list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))) AS apart, CASE WHEN turn % 4 = 0 THEN list_concat(a, b) ELSE b END AS words FROM w)"
    " SELECT conv_id, turn, len(apart) > 0 AND len(list_filter(apart, lambda x: NOT list_contains(words, x))) = 0 AS progress FROM d"
)
def set06_argument_words(spark, sf_dir):
    """User turns that differ from the turn before in nothing but words of its calls: here those of both turns, or of the first."""
    turns = spark.sql(_TURNS.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations")).where("before is not null")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    given = F.when(F.col("turn") % 4 == 0, F.concat(words("after"), words("before"))).otherwise(words("before"))
    return turns.select("conv_id", "turn", matching.progress(F.col("before"), F.col("after"), given).alias("progress"))


_DECLINES = "|".join(rag.DECLINES).replace("'", "''")
_OPENS = "|".join(rag.DECLINING_OPENERS)


@query(
    "WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Sadly I cannot answer: ' || text WHEN conv_id % 3 = 1 THEN text || ' I cannot answer.' ELSE text END AS reply, CASE WHEN conv_id % 5 = 0 THEN turn % 4 = 1 END AS flag, CASE WHEN conv_id % 5 = 1 THEN turn % 3 END AS claims FROM conversations WHERE role = 'assistant'),"
    r" f AS (SELECT *, regexp_extract(lower(trim(regexp_replace(reply, '\s+', ' ', 'g'))), '^(.*?[.!?])(?: |$)', 1) AS head, lower(trim(regexp_replace(reply, '\s+', ' ', 'g'))) AS low FROM r)"
    f" SELECT conv_id, turn, CASE WHEN flag IS NOT NULL THEN flag WHEN claims IS NOT NULL THEN claims = 0 ELSE regexp_matches(CASE WHEN head = '' THEN low ELSE head END, '{_DECLINES}|^[*_`\"'' ]*(?:{_OPENS})') END AS abstained FROM f"
)
def rst05_abstention(spark, sf_dir):
    """Replies that abstain: by an explicit flag, by the number of claims, or by the phrases of their first sentence."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    third, fifth = F.col("conv_id") % 3, F.col("conv_id") % 5
    reply = F.when(third == 0, F.concat(F.lit("Sadly I cannot answer: "), "text")).when(third == 1, F.concat("text", F.lit(" I cannot answer."))).otherwise(F.col("text"))
    flag, claims = F.when(fifth == 0, F.col("turn") % 4 == 1), F.when(fifth == 1, F.col("turn") % 3)
    return said.select("conv_id", "turn", rag.abstained(flag, claims, reply).alias("abstained"))
