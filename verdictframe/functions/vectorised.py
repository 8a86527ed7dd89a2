"""Scorers that need a table of partial results for each pair of texts: Arrow batches, one small helper a pair."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdictframe.functions.bitparallel import common_subsequence, edit_distance, edit_distances
from verdictframe.functions.text import ARTICLES, col


def _pairwise(score):
    """A column of score(output, target) over two text columns; a null counts as an empty text."""

    @F.pandas_udf(DoubleType())
    def run(output: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([float(score(a or "", b or "")) for a, b in zip(output, target, strict=True)])

    return lambda output, target: run(col(output), col(target))


_ARTICLES = re.compile(r"\b(a|an|the)\b")
_ASCII_PUNCTUATION = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_NOT_WORD = re.compile(r"[^\w\s]")


@lru_cache(maxsize=1 << 16)
def _bare(token: str) -> tuple[str, ...]:
    """What is left of a lower-case token without punctuation (of ASCII, and what Unicode classes so) and articles."""
    token = token.translate(_ASCII_PUNCTUATION)
    if not token.isascii():
        token = "".join(c for c in token if ord(c) < 128 or not unicodedata.category(c).startswith("P"))
    return tuple(_ARTICLES.sub(" ", token).split())


def squad_tokens(text: str) -> list[str]:
    """Lower-case tokens without punctuation and articles."""
    out: list[str] = []
    for token in text.lower().split():
        if token.isalnum():
            if token not in ARTICLES:
                out.append(token)
        else:
            out += _bare(token)
    return out


def grounding_tokens(text: str) -> list[str]:
    """Lower-case words; joiners are dropped, other punctuation is white space, combining marks stay."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u200c", "").replace("\u200d", "")
        marks = {c for c in text if ord(c) > 127 and unicodedata.category(c).startswith("M")}
        if marks:
            return "".join(c if c in marks or not _NOT_WORD.match(c) else " " for c in text).split()
    return _NOT_WORD.sub(" ", text).split()


def _shared(a: list[str], b: list[str]) -> int:
    x, y = Counter(a), Counter(b)
    return sum(min(x[t], y[t]) for t in x.keys() & y.keys())


def token_f1_score(output: str, target: str, tokens=squad_tokens) -> float:
    """F1 over multisets of tokens; two texts without tokens score 1."""
    a, b = tokens(output), tokens(target)
    return 2 * _shared(a, b) / (len(a) + len(b)) if a or b else 1.0


def jaccard_score(output: str, target: str) -> float:
    a, b = set(output.split()), set(target.split())
    return len(a & b) / len(a | b) if a or b else 1.0


def longest_overlap_score(output: str, target: str) -> float:
    """Shared tokens of the multisets by the longer token count; two empty texts score 0."""
    a, b = output.split(), target.split()
    return _shared(a, b) / max(len(a), len(b), 1)


def recall_score(output: str, target: str) -> float:
    """Share of the target's distinct tokens that the output has; 0 without any."""
    a, b = set(grounding_tokens(output)), set(grounding_tokens(target))
    return len(a & b) / len(b) if b else 0.0


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def sentence_bleu(output: str, target: str, max_n: int = 4) -> float:
    """Geometric mean of clipped n-gram precisions with a brevity penalty; no match counts 1e-12; 0 for an empty side."""
    a, b = output.split(), target.split()
    if not a or not b:
        return 0.0
    logs = []
    for n in range(1, min(max_n, max(len(a), len(b))) + 1):
        x, y = _grams(a, n), _grams(b, n)
        share = sum((x & y).values()) / max(1, sum(x.values()))
        logs.append(math.log(share or 1e-12))
    brevity = 1.0 if len(a) >= len(b) else math.exp(1 - len(b) / len(a))
    return brevity * math.exp(sum(logs) / len(logs))


def rouge_l_f1(output: str, target: str) -> float:
    a, b = output.split(), target.split()
    if not a and not b:
        return 1.0
    shared = common_subsequence(a, b) if a and b else 0
    return 2 * shared / (len(a) + len(b))


def _character_grams(text: str, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to n: the distinct runs of so many characters, as hashes, and how often each comes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, runs = [], points
    for k in range(1, n + 1):
        if k > 1:
            runs = (runs[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ points[k - 1 :]
            runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append(np.unique(runs, return_counts=True))
    return found


#: Texts of so many characters together are counted as strings, longer ones as arrays of hashes.
SHORT = 2000


def chrf_score(output: str, target: str, n: int = 6, beta: float = 1.0) -> float:
    """F of the mean precision and the mean recall of character n-grams, up to the longer text; 0 for an empty side."""
    if not output or not target:
        return 0.0
    orders = min(n, max(len(output), len(target)))
    p = r = 0.0
    if len(output) + len(target) <= SHORT:
        for k in range(1, orders + 1):
            x, y = (Counter([t[i : i + k] for i in range(len(t) - k + 1)]) for t in (output, target))
            shared = sum(min(c, y[g]) for g, c in x.items() if g in y)
            p += shared / max(1, len(output) - k + 1) / orders
            r += shared / max(1, len(target) - k + 1) / orders
        return 0.0 if p + r == 0 else (1 + beta**2) * p * r / (beta**2 * p + r)
    for (x, in_x), (y, in_y) in zip(_character_grams(output, orders), _character_grams(target, orders), strict=True):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = int(np.minimum(in_x[i], in_y[j]).sum())
        p += shared / max(1, int(in_x.sum())) / orders
        r += shared / max(1, int(in_y.sum())) / orders
    return 0.0 if p + r == 0 else (1 + beta**2) * p * r / (beta**2 * p + r)


def word_accuracy_score(output: str, target: str) -> float:
    """1 - word error rate, at least 0; without words in the target, 1 for an empty output and else 0."""
    a, b = output.split(), target.split()
    if not b:
        return 0.0 if a else 1.0
    return max(0.0, 1 - edit_distance(a, b) / len(b))


token_f1 = _pairwise(token_f1_score)
plain_token_f1 = _pairwise(lambda a, b: token_f1_score(a, b, str.split))
jaccard = _pairwise(jaccard_score)
longest_overlap = _pairwise(longest_overlap_score)
recall = _pairwise(recall_score)
bleu = _pairwise(sentence_bleu)
rouge_l = _pairwise(rouge_l_f1)
chrf = _pairwise(chrf_score)
word_accuracy = _pairwise(word_accuracy_score)


def character_accuracy_score(output: str, target: str) -> float:
    """1 - edit distance of the characters / the longer length; two empty texts score 0."""
    longer = max(len(output), len(target))
    return 1 - edit_distance(output, target) / longer if longer else 0.0


#: Characters of the pairs that are held at a time, so that many of them can be taken side by side.
HELD_CHARACTERS = 1 << 22


def character_accuracies(pairs: list[tuple[str, str]]) -> list[float]:
    """character_accuracy_score of each pair."""
    longer = [max(len(a), len(b)) for a, b in pairs]
    return [1 - d / n if n else 0.0 for d, n in zip(edit_distances(pairs), longer, strict=True)]


@F.pandas_udf(DoubleType())
def _character_accuracy(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    held: list[tuple[str, str]] = []
    size = 0
    for outputs, targets in batches:
        for a, b in zip(outputs, targets, strict=True):
            held.append((a or "", b or ""))
            size += len(held[-1][0]) + len(held[-1][1])
        if size >= HELD_CHARACTERS:
            yield pd.Series(character_accuracies(held), dtype="float64")
            held, size = [], 0
    yield pd.Series(character_accuracies(held), dtype="float64")


def character_accuracy(output: Column | str, target: Column | str) -> Column:
    """For long texts what scorers.levenshtein is for short ones: the built-in function fills the whole table, cell by cell.

    Best over rows in the order of their longer texts: pairs of one length are taken side by side. A null counts as an empty text.
    """
    return _character_accuracy(col(output), col(target))


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def json_score(text: str | None, keys: list[str]) -> float:
    try:
        value = json.loads(text or "", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return 0.0
    return float(not keys or isinstance(value, dict) and all(k in value for k in keys))


def is_json(output: Column | str, keys: list[str] = ()) -> Column:
    """1 for strict JSON (no NaN, nothing after the value) that is an object with all the keys, if any are named."""
    wanted = list(keys)

    @F.pandas_udf(DoubleType())
    def run(output: pd.Series) -> pd.Series:
        return pd.Series([json_score(x, wanted) for x in output])

    return run(col(output))
