"""Datasets as samples: CSV, JSON lines, Parquet and the layouts that training sets come in.

A sample row has sample_id, row_no, input, target, choices, contexts, tools, expected_tool_calls (JSON; null is no
reference, '[]' is no call), actual_output, kind and metadata (JSON of all other columns).
"""

from __future__ import annotations

import hashlib
import json

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that fill a field of the sample.
FIELDS = ["input", "target", "id", "task", "kind", "choices", "retrieval_context", "metadata", "tags", "actual_output", "tools", "expected_tool_calls", "reference_contexts", "actual_trace"]
SPLITS = ("test", "validation", "train")


def numbered(df: DataFrame) -> DataFrame:
    """df with row_no, its rows' place in the order of the files, without bringing them together.

    Rows are numbered within their partition, and partitions start after the counts of those before them.
    """
    part = df.withColumn("part__", F.spark_partition_id()).withColumn("order__", F.monotonically_increasing_id())
    counts = part.groupBy("part__").agg(F.count(F.lit(1)).alias("n")).withColumn("start__", F.sum("n").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)))
    placed = part.join(F.broadcast(counts.select("part__", F.coalesce("start__", F.lit(0)).alias("start__"))), "part__")
    return placed.withColumn("row_no", F.col("start__") + F.col("order__") % F.lit(1 << 33)).drop("part__", "order__", "start__")


def read_csv(spark: SparkSession, path: str, input_col: str = "input", target_col: str | None = "target", output_col: str | None = None) -> DataFrame:
    """Samples of a CSV file with a header; every cell is a text."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    missing = [c for c in (input_col, target_col, output_col) if c and c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {df.columns}")
    return to_samples(df, input_col, target_col, output_col)


def read_jsonl(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """Samples of JSON lines; blank lines are skipped, and the first line that is no object raises, with its number."""
    lines = numbered(spark.read.text(path)).where(F.length(F.trim("value")) > 0)
    bad = lines.where(F.try_parse_json("value").isNull() | ~F.ltrim(F.col("value")).startswith("{")).agg(F.min("row_no").alias("n")).first()["n"]
    if bad is not None:
        raise ValueError(f"{path}: line {bad + 1} is not a JSON object")
    schema = spark.read.json(lines.select("value").rdd.map(lambda r: r[0])).schema if lines.head(1) else "input string"
    rows = lines.select("row_no", F.from_json("value", schema).alias("v")).select("row_no", "v.*")
    for old, new in (field_map or {}).items():
        rows = rows.withColumnRenamed(old, new)
    return to_samples(rows)


def read_dataset(spark: SparkSession, path: str, split: str | None = None, input_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """Samples of a CSV, JSON-lines or Parquet path; a folder with splits gives the first of test, validation and train."""
    suffix = PurePosixPath(path).suffix
    if suffix == ".csv":
        return read_csv(spark, path, input_col or "input", target_col or "target")
    if suffix in (".jsonl", ".ndjson"):
        return read_jsonl(spark, path)
    df = spark.read.parquet(path)
    if "split" in df.columns:
        names = {r[0] for r in df.select("split").distinct().collect()}
        chosen = split or next((s for s in SPLITS if s in names), None)
        df = df.where(F.col("split") == chosen).drop("split")
    return to_samples(df, input_col, target_col)


def layout(columns: list[str]) -> str:
    """Which layout a table with these columns has."""
    if "instruction" in columns:
        return "alpaca"
    if "conversations" in columns or "messages" in columns:
        return "chat"
    if "prompt" in columns:
        return "preference"
    if "input" in columns:
        return "input"
    if "question" in columns:
        return "question"
    raise ValueError(f"cannot tell the input column from {sorted(columns)}; name it")


def _turn(turns: Column, field: tuple[str, str], names: set[str]) -> Column:
    a, b = (F.col(f) if False else f for f in field)
    return F.coalesce(*(turns[f] for f in (a, b) if f in names))


def _chat(df: DataFrame) -> tuple[Column, Column, set[str]]:
    """The last user turn and, if the chat ends with an assistant, its last text."""
    key = "conversations" if "conversations" in df.columns else "messages"
    names = set(df.schema[key].dataType.elementType.fieldNames())

    def role(t: Column) -> Column:
        return _turn(t, ("from", "role"), names)

    def text(t: Column) -> Column:
        return _turn(t, ("value", "content"), names)

    last = F.try_element_at(F.col(key), F.lit(-1))
    target = F.when(role(last).isin("gpt", "assistant"), text(last))
    asked = F.filter(key, lambda t: role(t).isin("human", "user"))
    return text(F.try_element_at(asked, F.lit(-1))), target, {key}


def to_samples(df: DataFrame, input_col: str | None = None, target_col: str | None = None, output_col: str | None = None) -> DataFrame:
    """Rows of any known layout as samples; named columns win over what the layout says."""
    names = df.columns

    def has(c: str) -> Column:
        return F.col(f"`{c}`") if c in names else F.lit(None).cast("string")

    if input_col:
        given, target, used = has(input_col), has(target_col) if target_col else F.lit(None).cast("string"), {input_col, target_col}
    else:
        kind = layout(names)
        if kind == "alpaca":
            more = F.when(F.length(has("input")) > 0, F.concat(F.lit("\n\n"), has("input"))).otherwise(F.lit(""))
            given, target, used = F.concat(F.col("instruction"), more), has("output"), {"instruction", "input", "output"}
        elif kind == "chat":
            given, target, used = _chat(df)
        else:
            i, t = {"preference": ("prompt", "chosen"), "input": ("input", "target"), "question": ("question", "answer")}[kind]
            given, target, used = has(i), has(t), {i, t}
    if output_col:
        used = used | {output_col}
    rest = [c for c in names if c not in used and c not in FIELDS and c != "row_no"]
    metadata = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("{}")
    rows = df if "row_no" in names else numbered(df)
    tools, calls, contexts = has("tools"), has("expected_tool_calls"), has("retrieval_context")
    return rows.select(
        F.coalesce(has("id").cast("string"), F.col("row_no").cast("string")).alias("sample_id"),
        "row_no",
        given.cast("string").alias("input"),
        target.cast("string").alias("target"),
        has("choices").alias("choices"),
        contexts.alias("contexts"),
        tools.alias("tools"),
        calls.alias("expected_tool_calls"),
        (has(output_col) if output_col else has("actual_output")).cast("string").alias("actual_output"),
        F.coalesce(has("kind"), F.when(tools.isNotNull() | calls.isNotNull(), "agent").when(contexts.isNotNull(), "rag").otherwise("generation")).alias("kind"),
        has("task").alias("task"),
        metadata.alias("metadata"),
    )


def gsm8k(df: DataFrame) -> DataFrame:
    """Math word problems (question, answer): the target is the number after the last ####."""
    answer = F.replace(F.trim(F.substring_index("answer", "####", -1)), F.lit(","), F.lit(""))
    return df.select(F.col("question").alias("input"), answer.alias("target"))


def unpivot_languages(df: DataFrame, id_col: str, languages: list[str], limit: int | None = None) -> DataFrame:
    """Wide prompts to long ones, a row a language; blank cells are skipped, and limit holds for the prompts."""
    rows = df if limit is None else df.orderBy(id_col).limit(limit)
    long = rows.unpivot([id_col], languages, "lang", "input")
    return long.where(F.length(F.trim("input")) > 0)


def inspect(df: DataFrame, by: str, group: str) -> DataFrame:
    """What a dataset holds: n rows and n_conversations (distinct groups) of each kind."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_conversations"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A sample for each line of a text that isn't blank."""
    return numbered(spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("input")))


def listed(spark: SparkSession, rows: list[dict], schema: str) -> tuple[str, DataFrame]:
    """Samples held in memory, as a table, and a name for it that follows from what they say."""
    name = hashlib.sha256(json.dumps(rows, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"list_{name}", spark.createDataFrame([tuple(r.get(f.name) for f in _parse(schema)) for r in rows], schema)


def _parse(schema: str):
    return StructType.fromDDL(schema).fields


#: How the files of a dataset descriptor are read, by their encoding.
ENCODINGS = {"text/csv": "csv", "application/jsonlines": "json", "application/x-ndjson": "json", "application/json": "json", "application/x-parquet": "parquet", "application/vnd.apache.parquet": "parquet"}


def read_croissant(spark: SparkSession, path: str, record_set: str, input_col: str = "input", target_col: str = "target") -> DataFrame:
    """input and target of a record set that a dataset descriptor (JSON-LD) describes, read from its files beside the descriptor."""
    described = json.loads(spark.read.text(path, wholetext=True).first()["value"])

    def named(items: list[dict], name: str) -> dict:
        found = [i for i in items if name in (i.get("name"), i.get("@id"))]
        if not found:
            raise ValueError(f"{path} has no {name!r}")
        return found[0]

    fields = named(described.get("recordSet", []), record_set).get("field", [])

    def source(column: str) -> dict | None:
        mine = [f for f in fields if str(f.get("name") or f.get("@id")).rsplit("/", 1)[-1] == column]
        return mine[0]["source"] if mine else None

    wanted = source(input_col)
    if wanted is None:
        raise ValueError(f"{record_set!r} has no field {input_col!r}")
    file = wanted.get("fileObject") or wanted.get("fileSet") or wanted.get("distribution")
    spread = named(described.get("distribution", []), file["@id"] if isinstance(file, dict) else file)
    place = spread.get("contentUrl") or spread.get("includes")
    form = ENCODINGS.get(spread.get("encodingFormat"))
    if form is None:
        raise ValueError(f"no reader for {spread.get('encodingFormat')!r}")
    where = place if "://" in place or place.startswith("/") else f"{path.rsplit('/', 1)[0]}/{place}"
    rows = spark.read.option("header", True).csv(where) if form == "csv" else spark.read.format(form).load(where)

    def column(of: dict | None, name: str) -> Column:
        inner = (of or {}).get("extract", {}).get("column")
        return (F.col(f"`{inner}`") if inner else F.lit(None)).cast("string").alias(name)

    return rows.select(column(wanted, "input"), column(source(target_col), "target"))
