"""Outcome oracles over episodes: missing evidence is unknown, never failure."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.text import bind


def normal(c: Column) -> Column:
    """Lower case, thousands commas dropped, runs of blanks, $, commas and % as one blank, full stops stripped."""
    bare = F.regexp_replace(c.cast("string"), r"(?<=\d),(?=\d{3}\b)", "")
    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce(bare, F.lit(""))), r"[\s$,%]+", " "))
    return F.regexp_replace(squeezed, r"^\.+|\.+$", "")


def stands_apart(text: Column, part: Column) -> Column:
    """Whether a part stands somewhere in a text and is no piece of a longer word or number there."""
    around = F.split(F.replace(text, part, F.lit("\x00")), "\x00", -1)
    left = F.slice(around, F.lit(1), F.greatest(F.size(around) - 1, F.lit(0)))
    apart = F.zip_with(left, F.slice(around, 2, F.size(left)), lambda a, b: ~F.coalesce(F.right(a, F.lit(1)).rlike(r"[\w.]") | F.left(b, F.lit(1)).rlike(r"\w"), F.lit(False)))
    return (F.length(part) > 0) & F.exists(apart, lambda x: x)


def verdict(evidence: Column, holds: Column) -> Column:
    """unknown without evidence, else success or failure."""
    return F.when(evidence.isNull(), "unknown").when(holds, "success").otherwise("failure")


def state_assertion(state_json: Column, key: str, equals: str | None = None, contains: str | None = None) -> Column:
    """Whether a key of a state (JSON object) has a value; unknown without a state or without the key."""
    value = F.get_json_object(state_json, f"$.{key}")
    holds = F.lit(True)
    if equals is not None:
        holds = holds & (value == F.lit(equals))
    if contains is not None:
        holds = holds & F.contains(value, F.lit(contains))
    return verdict(value, holds)


artifact_assertion = state_assertion


def answer_assertion(answer: Column, reference: Column, mode: str = "normalized") -> Column:
    """Whether an answer is its reference: exact, normalized, or contains (on the borders of tokens)."""
    if mode == "exact":
        holds = answer.cast("string") == reference.cast("string")
    elif mode == "normalized":
        holds = normal(answer) == normal(reference)
    elif mode == "contains":
        holds = bind(stands_apart, normal(answer), normal(reference))
    else:
        raise ValueError("mode must be 'exact', 'normalized' or 'contains'")
    return verdict(F.when(reference.isNotNull(), answer), holds)


def disagreement(oracle: Column, other: Column) -> Column:
    """Whether another verdict contradicts a decided oracle; null while the oracle is undecided or the other missing."""
    decided = oracle.isin("success", "failure") & other.isNotNull()
    return F.when(decided, oracle != other)


def budget_exhausted(steps: Column, most_steps: Column, ms: Column, most_ms: Column) -> Column:
    return F.coalesce(steps > most_steps, F.lit(False)) | F.coalesce(ms > most_ms, F.lit(False))


def custom(evidence: Column, predicate: Callable[[Column], Column]) -> Column:
    """A predicate of one's own over an episode's evidence; a null verdict, like no evidence, is unknown."""
    held = predicate(evidence)
    return F.when(held.isNotNull(), verdict(evidence, held)).otherwise("unknown")


def from_spec(spec: Mapping[str, object], state: Column, answer: Column, reference: Column) -> Column:
    """The verdict of an oracle that data describes: kind state (key, equals, contains) or answer (mode)."""
    kind = spec.get("kind")
    if kind == "state":
        return state_assertion(state, str(spec["key"]), spec.get("equals"), spec.get("contains"))
    if kind == "answer":
        return answer_assertion(answer, reference, str(spec.get("mode", "normalized")))
    raise ValueError(f"no oracle of kind {kind!r}")


def python_predicate(predicate: Callable[[str], object], version: str) -> Callable[[Column], Column]:
    """A plain function over an episode's evidence as an oracle: true, false or a verdict's name; what it raises is an error.

    The version stands for what the function does: change it with the function.
    """
    if not version:
        raise ValueError("a predicate needs a version")

    def one(evidence: str | None) -> str:
        if evidence is None:
            return "unknown"
        try:
            said = predicate(evidence)
        except Exception:  # noqa: BLE001
            return "error"
        if said is None or said in ("success", "failure", "unknown"):
            return said or "unknown"
        return "success" if said is True else "failure" if said is False else "error"

    @F.pandas_udf("string")
    def run(evidence: pd.Series) -> pd.Series:
        return pd.Series([one(e) for e in evidence])

    run.version = version
    return lambda evidence: run(evidence)
