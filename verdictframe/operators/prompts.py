"""Prompts, annotations and the filters and joins that come before a run."""

from __future__ import annotations

import re

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.text import bind


def generation(text: Column) -> Column:
    return text


def mcq_joint(question: Column, choices: Column) -> Column:
    """The question, the numbered choices and 'Answer:'."""
    numbered = F.transform(choices, lambda c, i: F.concat(i.cast("string"), F.lit(". "), c))
    return F.concat(question, F.lit("\n\n"), F.array_join(numbered, "\n"), F.lit("\n\nAnswer:"))


def mcq_loglikelihood(rows: DataFrame, question: Column, choices: str) -> DataFrame:
    """A row for each choice: choice_no, and the prompt with the choice as its continuation."""
    each = rows.withColumn("question__", question).select("*", F.posexplode(choices).alias("choice_no", "choice"))
    return each.withColumn("prompt", F.concat("question__", F.lit(" "), "choice")).drop("question__")


def chat(text: Column, system: str | None = None) -> Column:
    """The flattened form of a chat of one turn."""
    user = F.concat(F.lit("User: "), text)
    return user if system is None else F.concat(F.lit(f"System: {system}\n\n"), user)


def few_shot(text: Column, shots: list[str], separator: str = "\n\n") -> Column:
    """A prompt behind examples that are given."""
    return F.concat(F.lit("".join(s + separator for s in shots)), text)


def instruction(words: str, text: Column) -> Column:
    return F.concat(F.lit(f"{words}\n"), text)


def rag(text: Column, contexts: Column, separator: str = "\n\n", most: int | None = None) -> Column:
    """The question and its contexts, cut at most characters with '...'."""
    joined = F.array_join(contexts, "\n")
    if most is not None:
        joined = F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)
    return F.concat(text, F.lit(separator), joined)


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """A template with {name} fields as one concatenation, so that a value's own braces stay as they are."""
    parts = [F.lit(p) if k % 2 == 0 else F.coalesce(fields[p], F.lit("")) for k, p in enumerate(re.split(r"\{(\w+)\}", pattern))]
    return F.concat(*parts)


def regex_annotation(text: Column, pattern: str, group: int = 0, otherwise: str | None = None) -> Column:
    """The group of the first match, else the given text, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(F.lit(otherwise))


def extracted(raw: Column, annotation: Column) -> Column:
    """What is scored: the annotation, or the raw output where there is none."""
    return F.coalesce(annotation, raw)


def applicable(*columns: str) -> Column:
    """Whether all columns are present; empty texts and arrays are."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isNotNull()
    return found


def kind(tools: Column, calls: Column, contexts: Column) -> Column:
    """The kind of a sample by what it has."""
    return F.when(tools.isNotNull() | calls.isNotNull(), "agent").when(contexts.isNotNull(), "rag").otherwise("generation")


def join_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (id, prefix) with answers of the same id, else one spare answer of the same prefix, else null.

    An answer whose id some question has is no spare; of several spares of a prefix the smallest answer_id serves.
    """
    own = questions.join(answers.select("id", "answer_id"), "id", "left")
    spare = answers.join(questions.select("id"), "id", "left_anti").groupBy("prefix").agg(F.min("answer_id").alias("spare_id"))
    return own.join(spare, (own["prefix"] == spare["prefix"]) & own["answer_id"].isNull(), "left").withColumn("answer_id", F.coalesce("answer_id", "spare_id"))


def tool_prompt(text: Column, tools: Column, system: str | None = None) -> Column:
    """A prompt that offers tools (JSON schemas, as one text) to a model without a channel of their own for them."""
    head = F.lit("" if system is None else f"{system}\n\n")
    asked = F.concat(F.lit("You can call these tools:\n"), tools, F.lit('\n\nTo call one, answer <tool_call>{"name": ..., "arguments": {...}}</tool_call>.\n\nUser: '), text)
    return F.concat(head, asked)


def route(samples: DataFrame) -> str:
    """How a dataset is prompted: its first sample (by row_no) decides."""
    first = samples.orderBy("row_no").select("tools", "choices", "contexts").head(1)
    if not first:
        return "generation"
    tools, choices, contexts = first[0]
    return "tool_call" if tools is not None else "mcq" if choices else "rag" if contexts else "generation"


def requests(samples: DataFrame, prompts: Column) -> DataFrame:
    """An adapter of one's own: samples with request_no and prompt, a row for each of the prompts (an array) that it makes of one."""
    return samples.select("*", F.posexplode(prompts).alias("request_no", "prompt"))


def annotate(samples: DataFrame, name: str, kind: str, annotator: Callable[..., object], *columns: str) -> DataFrame:
    """samples with a column that a plain function makes of others, in Arrow batches, and name_error where it failed."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(*values: pd.Series) -> pd.DataFrame:
        rows = []
        for row in zip(*values, strict=True):
            try:
                rows.append((annotator(*row), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    made = samples.withColumn("made__", run(*(F.col(f"`{c}`") for c in columns)))
    return made.select(*(F.col(f"`{c}`") for c in samples.columns), F.col("made__.value").alias(name), F.col("made__.error").alias(f"{name}_error"))


def few_shot_from(samples: DataFrame, pool: DataFrame, n: int, *order: str, separator: str = "\n\n") -> DataFrame:
    """samples with prompt: their input behind the first n examples (input, target) of a pool, in its order.

    The n examples come to the driver; a pool with fewer raises.
    """
    shots = pool.orderBy(*order).select("input", "target").limit(n).collect() if n else []
    if len(shots) < n:
        raise ValueError(f"{n} examples are wanted, and the pool has {len(shots)}")
    return samples.withColumn("prompt", few_shot(F.col("input"), [f"{s['input']}\n{s['target'] or ''}" for s in shots], separator))


def cast_annotation(text: Column, kind: str) -> Column:
    """(extracted, value, cast_failed): an annotation's text, its value of a type, and whether it has one and can't be cast."""

    def read(t: Column) -> Column:
        value = t.try_cast(kind)
        return F.struct(t.alias("extracted"), value.alias("value"), (t.isNotNull() & value.isNull()).alias("cast_failed"))

    return bind(read, text)
