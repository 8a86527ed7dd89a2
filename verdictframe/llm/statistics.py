"""Statistics of whole texts, vectorised over the bytes of a batch: the features of the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdictframe.llm.cluster import only
from verdictframe.llm.text_kernel import SPACED, shingles, split_words, word_chunks

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "digit_share",
    "exclamations_a_word",
    "stops_a_word",
    "commas_a_word",
    "dup_line_share",
    "repeat_word_share",
    "stutter_share",
    "lines_a_word",
    "foreign_share",
    "log_line_length",
]

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _LOUD, _STOP, _COMMA, _TAIL, _LEAD, _OTHER = range(12)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = _LOWER, _UPPER, _DIGIT
for _kind, _characters in ((_SPACE, " \t\v\f\r"), (_LINE, "\n"), (_SYMBOL, SYMBOLS), (_LOUD, "!?"), (_STOP, "."), (_COMMA, ",;:")):
    _CLASS[[ord(c) for c in _characters]] = _kind
_CLASS[0x80:0xC0], _CLASS[0xC0:] = _TAIL, _LEAD
_NOT_NEWLINE = np.arange(256) != 0x0A


def _by_doc(flags: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[flags], minlength=n)


def _repeated(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of values that their text has twice or more, and of those that their text had before."""
    often, again = np.zeros(len(values), bool), np.zeros(len(values), bool)
    stop = np.cumsum(np.bincount(doc, minlength=n))
    for a, b in zip(np.concatenate([[0], stop[:-1]]), stop, strict=True):
        if b - a < 2:
            continue
        order = np.argsort(values[a:b], kind="stable")
        v = values[a:b][order]
        same = v[1:] == v[:-1]
        if same.any():
            later = order[1:][same] + a
            again[later] = True
            often[later] = True
            often[order[:-1][same] + a] = True
    return often, again


def text_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x BASE, int64) and the features (rows x FEATURES, float64) of the texts of a column."""
    base, features = [np.zeros((0, len(BASE)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for _, words in word_chunks(column, SPACED, lower=False):
        n, data = words.n_docs, words.data
        byte_doc = np.repeat(np.arange(n), np.diff(words.offsets))
        counts = np.bincount(byte_doc * 12 + _CLASS[data], minlength=n * 12).reshape(n, 12)
        not_tail = np.concatenate([[0], np.cumsum((data < 0x80) | (data >= 0xC0))])
        chars = np.bincount(words.doc, weights=not_tail[words.ends] - not_tail[words.starts], minlength=n).astype(np.int64)

        hashes = words.hashes()
        stutter = _by_doc((hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]), words.doc[1:], n) if len(hashes) else np.zeros(n, np.int64)
        windows, window_doc = shingles(hashes, words, 3)
        often, _ = _repeated(windows, window_doc, n)
        has = np.maximum(words.counts - 2, np.minimum(words.counts, 1))
        begin = (np.repeat(words.first()[:-1] - np.concatenate([[0], np.cumsum(has)])[:-1], has) + np.arange(len(windows)))[often]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[begin + k] = True
        repeat = _by_doc(covered, words.doc, n)

        lines = split_words(data, words.offsets, _NOT_NEWLINE)
        wordy = np.concatenate([[0], np.cumsum(SPACED[data])])
        full = wordy[lines.ends] > wordy[lines.starts]
        _, again = _repeated(lines.hashes()[full], lines.doc[full], n)
        dup_lines, n_lines = _by_doc(again, lines.doc[full], n), np.bincount(lines.doc[full], minlength=n)

        some, n_chars = np.maximum(words.counts, 1), np.maximum(counts.sum(1) - counts[:, _TAIL], 1)
        letters = counts[:, _LOWER] + counts[:, _UPPER] + 1
        base.append(np.stack([words.counts, chars, counts[:, _SYMBOL], dup_lines, repeat], axis=1))
        features.append(
            np.stack(
                [
                    np.log1p(words.counts),
                    np.minimum(chars / some, 40),
                    counts[:, _SYMBOL] / n_chars,
                    counts[:, _UPPER] / letters,
                    counts[:, _DIGIT] / n_chars,
                    np.minimum(counts[:, _LOUD] / some, 3),
                    np.minimum(counts[:, _STOP] / some, 3),
                    np.minimum(counts[:, _COMMA] / some, 3),
                    dup_lines / np.maximum(n_lines, 1),
                    repeat / some,
                    stutter / some,
                    np.minimum(n_lines / some, 1),
                    counts[:, _LEAD] / n_chars,
                    np.log1p(n_chars / np.maximum(n_lines, 1)),
                ],
                axis=1,
            )
        )
    return np.concatenate(base), np.concatenate(features)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, features = text_statistics(batch.column(1))
        flat = pa.array(np.ascontiguousarray(features).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in base.T), lists], names=["doc_id", *BASE, "features"])


def document_statistics(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts and the features (array of double). A null text counts as an empty one."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return only(documents, "doc_id", "text").mapInArrow(_rows, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, features array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column of features as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))
