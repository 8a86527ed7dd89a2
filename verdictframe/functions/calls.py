"""Tool calls in replies: a reply's text becomes an array of calls, in one pass over its marks.

A reply that is JSON as a whole is its calls. Otherwise calls stand in <tool_call> blocks (outside reasoning), in an
action list of {"tool_name", "parameters"} objects, or in one fenced JSON block, in this order. A closed block that
isn't a call, and a last block that begins like one but breaks off, are calls with a parse_error.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from verdictframe.functions.text import col

CALL = StructType([StructField("name", StringType()), StructField("arguments", StringType()), StructField("parse_error", StringType())])
_MARK = re.compile(r"<tool_call>|</tool_call>|<think>|</think>")
_BLANK = re.compile(r"\s*")
_BEGINS = re.compile(r'\{\s*"(?:name|function|tool_name)"\s*:')
_NAME = re.compile(r'"(?:name|tool_name)"\s*:\s*"([^"\\]*)"')
_FENCE = re.compile(r"```(?:json|tool_call)?\n(.*?)\n?```", re.S)
_DECODER = json.JSONDecoder()
#: Fixed value: the pseudo-tools by which a model says that it answers without a tool.
DIRECT = {"directly-answer", "directly_answer"}


def call_of(value: dict) -> tuple[str, str | None, str | None] | None:
    """One call in any of its spellings: name or tool_name, arguments or parameters, or all under function."""
    inner = value["function"] if isinstance(value.get("function"), dict) else value
    name = inner.get("name") or inner.get("tool_name") or (inner["function"] if isinstance(inner.get("function"), str) else None)
    if not isinstance(name, str):
        return None
    arguments = next((inner[k] for k in ("arguments", "parameters", "args", "input") if k in inner), {})
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments or "{}")
        except ValueError:
            return name, None, "arguments are no JSON"
    if not isinstance(arguments, dict):
        return name, None, "arguments are no object"
    return name, json.dumps(arguments, sort_keys=True, ensure_ascii=False), None


def calls_of(value) -> list[tuple] | None:
    """The calls of a JSON value that is a call, or a list of nothing but calls; null otherwise."""
    items = value if isinstance(value, list) else [value]
    found = [call_of(v) if isinstance(v, dict) else None for v in items]
    return None if None in found or not found else [c for c in found if c[0] not in DIRECT]


def _read(text: str) -> list[tuple] | None:
    try:
        return calls_of(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _tagged(text: str) -> list[tuple]:
    """Calls of the tagged blocks. Marks inside a block's own JSON are skipped, as decoding goes past them."""
    out: list[tuple] = []
    start = 0  # of the calls since reasoning was last left
    thinking, at = False, 0
    while m := _MARK.search(text, at):
        at = m.end()
        if m[0] == "<think>":
            start, thinking = len(out), True
        elif m[0] == "</think>":
            del out[start if thinking else 0 :]
            thinking = False
        elif m[0] == "<tool_call>":
            begin = _BLANK.match(text, at).end()
            try:
                value, end = _DECODER.raw_decode(text, begin)
            except (ValueError, RecursionError):
                nxt = _MARK.search(text, at)
                if nxt and nxt[0] == "</tool_call>":
                    out.append(("", None, f"no call: {text[at : nxt.start()].strip()[:200]}"))
                elif nxt is None and _BEGINS.match(text, begin):
                    name = _NAME.search(text, begin)
                    out.append((name[1] if name else "", None, "truncated"))
                continue
            found, at = calls_of(value), end
            closing = text[end : end + 100].lstrip().startswith("</tool_call>")
            if found is not None:
                out += found
            elif closing:
                out.append(("", None, f"no call: {text[begin:end][:200]}"))
    return out


def _action_list(text: str) -> list[tuple]:
    """The first list of objects with a tool_name."""
    at = text.find("[")
    while at >= 0 and text.find('"tool_name"', at) >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            value = None
        if value and isinstance(value, list) and all(isinstance(v, dict) and "tool_name" in v for v in value):
            return calls_of(value) or []
        at = text.find("[", at + 1)
    return []


def parse_calls(text: str | None) -> list[tuple]:
    """(name, arguments, parse_error) of all calls of a reply."""
    text = (text or "").strip()
    if text[:1] in ("{", "[") and (whole := _read(text)) is not None:
        return whole
    if "<tool_call>" in text:
        return _tagged(text)
    if '"tool_name"' in text and (listed := _action_list(text)):
        return listed
    fenced = _FENCE.findall(text) if "```" in text else []
    return (_read(fenced[0]) or []) if len(fenced) == 1 else []


def tool_calls(output: Column | str) -> Column:
    """The calls of a reply as an array of (name, arguments, parse_error); no calls for a null."""

    @F.pandas_udf(ArrayType(CALL))
    def run(output: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(CALL.fieldNames(), c, strict=True)) for c in parse_calls(x)] for x in output])

    return run(col(output))
