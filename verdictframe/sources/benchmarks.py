"""Public benchmarks in their own layouts, as samples: input, target, choices, task, kind and what the scorers need."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.sources.datasets import gsm8k


def _choice(question: str, choices: Column, target: Column) -> list[Column]:
    return [F.col(question).alias("input"), choices.cast("array<string>").alias("choices"), target.cast("string").alias("target"), F.lit("mcq").alias("kind")]


def arc(df: DataFrame) -> DataFrame:
    """question, choices (text, label) and answerKey: the target is the letter."""
    return df.select(*_choice("question", F.col("choices.text"), F.col("answerKey")))


def hellaswag(df: DataFrame) -> DataFrame:
    """ctx, endings and label: the target is the place of the right ending."""
    return df.select(*_choice("ctx", F.col("endings"), F.col("label")))


def mmlu(df: DataFrame) -> DataFrame:
    """question, choices and answer (a place)."""
    return df.select(*_choice("question", F.col("choices"), F.col("answer")))


def truthfulqa(df: DataFrame, *keep: str) -> DataFrame:
    """question and mc1_targets (choices, labels): the target is the place of the first true choice, 0 without one."""
    first = F.greatest(F.array_position("mc1_targets.labels", 1) - 1, F.lit(0))
    return df.select(*keep, *_choice("question", F.col("mc1_targets.choices"), first))


def humaneval(df: DataFrame) -> DataFrame:
    """prompt and canonical_solution."""
    return df.select(F.col("prompt").alias("input"), F.col("canonical_solution").alias("target"), F.lit("generation").alias("kind"))


SCENARIOS: dict[str, Callable[[DataFrame], DataFrame]] = {"arc": arc, "gsm8k": gsm8k, "hellaswag": hellaswag, "humaneval": humaneval, "mmlu": mmlu, "truthfulqa": truthfulqa}


def xstest(df: DataFrame) -> DataFrame:
    """prompt, type and, where there are, label and id: prompts that only look unsafe, and unsafe ones, told apart by label.

    Without a label it is read from the type's prefix. Score the two apart: a refusal fails the safe ones.
    """
    by_type = F.when(F.col("type").startswith("contrast_"), "unsafe").otherwise("safe")
    label = F.coalesce("label", by_type) if "label" in df.columns else by_type
    id_ = F.concat(F.lit("xstest-"), F.col("id").cast("string")) if "id" in df.columns else F.concat(F.lit("xstest-"), F.xxhash64("prompt").cast("string"))
    return df.select(id_.alias("sample_id"), F.col("prompt").alias("input"), F.lit("en").alias("task"), label.alias("label"), "type")


#: Categories of function-calling benchmarks that can be scored, and those whose right answer is no call.
SINGLE_TURN = ["simple", "multiple", "parallel", "parallel_multiple", "java", "javascript", "live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "sql"]
IRRELEVANCE = ["irrelevance", "live_irrelevance"]


def category_of(path: str) -> str:
    """The category that a question file is named after."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].split(".json")[0]
    parts = re.split(r"^BFCL_v\d+_", stem)
    if len(parts) != 2 or not parts[1]:
        raise ValueError(f"{path!r} is not named BFCL_v<n>_<category>.json")
    if parts[1] not in SINGLE_TURN + IRRELEVANCE:
        raise ValueError(f"the category {parts[1]!r} has no answers to score against")
    return parts[1]


def function_calls(questions: DataFrame, answers: DataFrame | None, category: str, dots_to_underscores: bool = False) -> DataFrame:
    """sample_id, input, task, tools (JSON), expected_tool_calls (JSON) and answer_id of a function-calling category.

    questions has id, question (JSON: messages, or a turn of them) and function (JSON); answers has id and ground_truth
    (JSON: calls with the accepted values of each argument). An answer whose id differs from its question's is paired by
    its index, the part before the first dash. A question without an answer is left out, but where no call is right.
    """
    turns = F.from_json(F.regexp_replace("question", r"(?s)^\s*\[\s*\[(.*)\]\s*\]\s*$", "[$1]"), "array<struct<role:string,content:string>>")
    asked = F.try_element_at(F.filter(turns, lambda m: m["role"] == "user"), F.lit(-1))["content"]
    rows = questions.select(F.col("id").alias("sample_id"), asked.alias("input"), F.lit(f"bfcl_{category}").alias("task"), F.col("function").alias("tools"))
    if category in IRRELEVANCE:
        return rows.withColumn("expected_tool_calls", F.lit("[]")).withColumn("answer_id", F.lit(None).cast("string"))
    if answers is None:
        raise ValueError(f"the category {category!r} needs its answers")
    index = F.substring_index("sample_id", "-", 1)
    own = answers.select(F.col("id").alias("answer_id"), F.col("ground_truth").alias("expected_tool_calls"))
    exact = rows.join(own, F.col("sample_id") == F.col("answer_id"))
    spare = own.join(rows.select(F.col("sample_id").alias("answer_id")), "answer_id", "left_anti").groupBy(F.substring_index("answer_id", "-", 1).alias("key")).agg(F.min_by("expected_tool_calls", "answer_id").alias("expected_tool_calls"), F.min("answer_id").alias("answer_id"))
    rest = rows.join(own.select(F.col("answer_id").alias("sample_id")), "sample_id", "left_anti").join(spare, index == F.col("key")).drop("key")
    found = exact.unionByName(rest)
    if dots_to_underscores:
        dotted = r'("name"\s*:\s*"[^".]*)\.([^"]*")'
        found = found.withColumn("tools", F.regexp_replace("tools", dotted, "$1_$2")).withColumn("expected_tool_calls", F.regexp_replace("expected_tool_calls", r'(\{\s*"[^".]*)\.([^"]*"\s*:\s*\{)', "$1_$2"))
    return found


def read_function_calls(spark, path: str, answers: str | None = None, dots_to_underscores: bool = False) -> DataFrame:
    """function_calls() of a question file (JSON lines) and its answers, by default in possible_answer beside it."""
    category = category_of(path)
    folder, name = path.rsplit("/", 1)

    def lines(file: str, *fields: str) -> DataFrame:
        raw = spark.read.text(file).where(F.trim("value") != "")
        return raw.select(*(F.get_json_object("value", f"$.{f}").alias(f) for f in fields))

    given = None if category in IRRELEVANCE else lines(answers or f"{folder}/possible_answer/{name}", "id", "ground_truth")
    return function_calls(lines(path, "id", "question", "function"), given, category, dots_to_underscores)
