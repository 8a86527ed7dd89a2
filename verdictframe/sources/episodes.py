"""Episodes: chat messages as ordered events, with what their log observes; and evidence joined by explicit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events_of_messages(messages: DataFrame) -> DataFrame:
    """Events of chat messages (episode_id, msg_no, role, content, tool_calls, call_id).

    tool_calls is an array of (id, name, arguments). An assistant's calls become one tool_call each and its text is
    dropped; a tool message is a tool_result; an assistant's text is text; users and systems are observations. All
    calls of one message share its number as their turn.
    """
    calls = messages.where("role = 'assistant' and size(tool_calls) > 0").select("episode_id", "msg_no", "role", F.posexplode("tool_calls").alias("call_no", "c"))
    called = calls.select("episode_id", "msg_no", "call_no", "role", F.lit("tool_call").alias("type"), F.col("c.name").alias("name"), F.col("c.arguments").alias("payload"), F.col("c.id").alias("call_id"))
    kind = F.when(F.col("role") == "tool", "tool_result").when(F.col("role") == "assistant", "text").otherwise("observation")
    plain = messages.where("not (role = 'assistant' and coalesce(size(tool_calls), 0) > 0)").select(
        "episode_id", "msg_no", F.lit(0).alias("call_no"), "role", kind.alias("type"), F.lit(None).cast("string").alias("name"), F.col("content").alias("payload"), F.when(F.col("role") == "tool", F.col("call_id")).alias("call_id")
    )
    idx = F.row_number().over(Window.partitionBy("episode_id").orderBy("msg_no", "call_no")) - 1
    return called.unionByName(plain).select("episode_id", idx.alias("idx"), "role", "type", "name", "payload", "call_id", F.col("msg_no").alias("turn_id"))


def coverage(events: DataFrame) -> DataFrame:
    """Per episode: whether calls and their results were observed, its final answer, and a label."""
    def seen(kind: str) -> Column:
        return F.coalesce(F.bool_or(F.col("type") == kind), F.lit(False))

    answer = F.max_by(F.when(F.col("type") == "text", F.col("payload")), F.when(F.col("type") == "text", F.col("idx")))
    by = events.groupBy("episode_id").agg(
        seen("tool_call").alias("calls"), seen("tool_result").alias("results"), seen("text").alias("texts"), F.bool_or((F.col("type") == "tool_call") & F.col("payload").isNotNull()).alias("arguments"), answer.alias("final_answer")
    )
    label = F.when(F.col("calls") & F.col("arguments"), "full").when(F.col("calls"), "tool_names_only").when(F.col("final_answer").isNotNull(), "answer_only").otherwise("none")
    return by.withColumn("coverage", label)


def log_turns(events: DataFrame) -> DataFrame:
    """events of a log with turn_id: how many turn_complete events stand before; null where a log has none."""
    w = Window.partitionBy("episode_id")
    ends = F.sum((F.col("type") == "turn_complete").cast("int"))
    before = ends.over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("turn_id", F.when(ends.over(w) > 0, F.coalesce(before, F.lit(0))))


def calls(events: DataFrame) -> DataFrame:
    return events.where("type = 'tool_call'").select("episode_id", F.col("turn_id").alias("turn"), "idx", "name", F.col("payload").alias("arguments"), "call_id")


def flat_ids(c: Column) -> Column:
    """Ids given as an array in JSON, or as one text, as an array of texts."""
    return F.coalesce(F.from_json(c, "array<string>"), F.when(F.length(F.trim(c)) > 0, F.array(c)))


#: Keys that identify an episode, a case or a call; others describe evidence and never carry a join.
IDENTITY_KEYS = ["source_id", "case_id", "trial_id", "call_id"]


def join_evidence(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """wanted (request_id, evidence_id, key, value) met with evidence by explicit ids: joined, and if not, the reason.

    evidence has evidence_id, granularity (aggregate, per_case, per_event) and join_keys (map of key to array of
    values, one a record). A request joins when each of its keys is carried, an identity key is among them, no
    per-case key meets aggregate evidence, all list-valued keys match the same record, and per-event evidence is
    given its call_id. Otherwise the first reason in that order is reported.
    """
    asked = wanted.groupBy("request_id", "evidence_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("by"))
    both = asked.join(evidence, "evidence_id", "left")
    keys = F.map_keys("by")
    places = F.transform(keys, lambda k: F.filter(F.sequence(F.lit(0), F.greatest(F.size(F.element_at("join_keys", k)) - 1, F.lit(0))), lambda i: F.get(F.element_at("join_keys", k), i) == F.element_at("by", k)))
    lists = F.filter(F.arrays_zip(keys.alias("k"), places.alias("p")), lambda z: F.size(F.element_at("join_keys", z["k"])) > 1)
    unmatched = F.exists(places, lambda p: F.size(p) == 0)
    same = F.aggregate(F.transform(lists, lambda z: z["p"]), F.lit(None).cast("array<int>"), lambda acc, p: F.when(acc.isNull(), p).otherwise(F.array_intersect(acc, p)))
    identity = F.array(*map(F.lit, IDENTITY_KEYS))
    reason = (
        F.when(F.col("granularity").isNull(), "no such evidence")
        .when((F.col("granularity") == "aggregate") & F.arrays_overlap(keys, identity), "aggregate evidence")
        .when(F.exists(keys, lambda k: ~F.map_contains_key("join_keys", k)), "unknown key")
        .when(~F.arrays_overlap(keys, identity), "no identity key")
        .when(F.exists(F.map_values("by"), lambda v: v.isNull() | (F.trim(v) == "")), "no value")
        .when(unmatched, "value does not match")
        .when(same.isNotNull() & (F.size(same) == 0), "not the same record")
        .when((F.col("granularity") == "per_event") & ~F.array_contains(keys, "call_id"), "no call_id")
    )
    return both.select("request_id", "evidence_id", reason.isNull().alias("joined"), reason.alias("reason"))


def answer_text(c: Column) -> Column:
    """The text inside the first <answer> tag, else the whole text; an empty text for a null."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    pattern = r"(?is)<answer>(.*?)</answer>"
    return F.regexp_replace(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text), r"^\s+|\s+$", "")


def trace_samples(rows: DataFrame) -> DataFrame:
    """Rollout records (question, gold_answer, final_answer, retrieved_chunk_ids, gold_chunk_ids) as samples.

    Their tool calls name no tools, so they stay out of tool-call scores; answers and retrieval can be scored. A
    record's trajectory_id, where the table has one, is the sample's id.
    """
    id_ = F.col("trajectory_id").cast("string") if "trajectory_id" in rows.columns else F.lit(None).cast("string")

    def ids(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("array<string>")
        return flat_ids(F.col(name)) if rows.schema[name].dataType.simpleString() == "string" else F.col(name).cast("array<string>")

    return rows.select(id_.alias("sample_id"), F.col("question").alias("input"), F.col("gold_answer").cast("string").alias("target"), answer_text(F.col("final_answer")).alias("actual_output"), ids("retrieved_chunk_ids").alias("retrieved"), ids("gold_chunk_ids").alias("reference_contexts"))


def task_samples(rows: DataFrame) -> DataFrame:
    """Task records (prompt, answer or gold_answer, question_id) as samples: something to run, not a result.

    A prompt is a text or an array of messages (role, content), of which the last user's is the input.
    """
    is_chat = rows.schema["prompt"].dataType.typeName() == "array"
    asked = F.try_element_at(F.filter("prompt", lambda m: m["role"] == "user"), F.lit(-1))["content"] if is_chat else F.col("prompt").cast("string")
    answers = [F.col(c).cast("string") for c in ("answer", "gold_answer") if c in rows.columns]
    target = F.coalesce(*answers) if answers else F.lit(None).cast("string")
    contexts = [flat_ids(F.col(c).cast("string")) for c in ("message_ids", "gold_chunk_ids", "gold_path") if c in rows.columns and rows.schema[c].dataType.typeName() == "string"]
    id_ = F.col("question_id").cast("string") if "question_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(id_.alias("sample_id"), asked.alias("input"), target.alias("target"), (F.coalesce(*contexts) if contexts else F.lit(None).cast("array<string>")).alias("reference_contexts"))


#: For each kind of foreign record, how fine it is and which of its fields are ids that can be joined.
EVIDENCE_KINDS = {
    "audit_report": ("aggregate", ["timestamp"]),
    "regression_report": ("aggregate", ["timestamp"]),
    "audit_event": ("per_event", ["tenant_id", "timestamp"]),
    "bench_row": ("per_case", ["prompt"]),
    "data_sample": ("per_case", ["id", "source_uri"]),
    "manifest": ("aggregate", ["pipeline_config_hash"]),
    "faithfulness_report": ("aggregate", []),
}


def evidence_of(records: DataFrame, kind: str, id_column: str) -> DataFrame:
    """Foreign records of a kind as evidence (evidence_id, granularity, join_keys); empty ids are no keys."""
    granularity, keys = EVIDENCE_KINDS[kind]
    present = [k for k in keys if k in records.columns]
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in present)), lambda e: F.length(F.trim(e["v"])) > 0) if present else F.array().cast("array<struct<key:string,v:string>>")
    keyed = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.array(e["v"]))))
    return records.select(F.col(id_column).cast("string").alias("evidence_id"), F.lit(granularity).alias("granularity"), keyed.alias("join_keys"))
