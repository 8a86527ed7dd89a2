"""Vectorised word handling over Arrow string columns, used inside Spark tasks.

Everything works on the UTF-8 bytes of a batch of texts: word boundaries come from a 256-entry byte table, and words
are hashed eight bytes at a time, all words of a chunk side by side, each step mixing the whole state (not a linear
function of the bytes, so that no structure of a text makes words collide); words beyond LONG bytes take BLAKE2b. No
Python object is made for a shorter word. Texts are taken in chunks of half a megabyte (a longer text is a chunk of
its own), which bounds the memory of a task. Null texts have no words.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U64 = np.uint64

_BYTE = np.arange(256)
#: Bytes of words when words are split at ASCII white space only.
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Bytes of words made of ASCII letters, digits and everything outside ASCII.
ALNUM = (
    (_BYTE >= 0x80)
    | ((_BYTE >= 0x30) & (_BYTE <= 0x39))
    | ((_BYTE >= 0x41) & (_BYTE <= 0x5A))
    | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_rng = np.random.default_rng(20240229)
_STEP = U64(0x9E3779B97F4A7C15)
#: Multipliers by which the words of a shingle are combined.
_PLACE = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
#: Longer byte runs are hashed one by one.
LONG = 256
#: The bytes of a little-endian word that belong to a run with so many bytes left.
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same for equal runs everywhere."""
    size = ends - starts
    out = mix(size.astype(U64) + _STEP)
    if not len(starts):
        return out
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = mix((out ^ (eight[starts] & _LEFT[np.minimum(size, 8)])) * _STEP + _STEP)
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[live] + 8, size[live] - 8
    while len(live):
        out[live] = mix((out[live] ^ (eight[at] & _LEFT[np.minimum(left, 8)])) * _STEP + _STEP)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """The words of a chunk of texts: start and end byte, the text each belongs to, and the texts' word counts."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def first(self) -> np.ndarray:
        """Index of each text's first word, with the total as last entry."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same for equal words everywhere."""
        return run_hashes(self.data, self.starts, self.ends)


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of texts whose bytes stand one after another in data; offsets has one entry more than there are texts."""
    base = int(offsets[0]) if len(offsets) else 0
    data = data[base : int(offsets[-1])]
    offsets = offsets - base
    inside = is_word[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first] |= inside[first]
        end[last] |= inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, doc, np.bincount(doc, minlength=max(0, len(offsets) - 1)))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; a null text is an empty one here."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if places else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes each, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_chunks(column: pa.Array, is_word: np.ndarray, lower: bool, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """For each chunk of a text column, the index of its first text and its words; lower: A-Z become a-z."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(data, offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, split_words(LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo], is_word)


def shingles(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of so many words and the text it stands in; a shorter text is one shingle, an empty one none.

    Runs come in the order of the texts and, in a text, in the order of their first words.
    """
    n = len(hashes)
    counts, first = words.counts, words.first()
    has = np.maximum(counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), has)
    if not len(doc):
        return np.zeros(0, U64), doc
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(has)])[:-1], has) + np.arange(len(doc))
    total = np.zeros(len(doc), U64)
    short = np.repeat(counts < size, has)
    stop = np.repeat(first[1:], has)
    for k in range(size):
        at = begin + k
        ok = at < stop if short.any() else None
        part = hashes[np.minimum(at, n - 1)] * _PLACE[k]
        total += part if ok is None else np.where(ok, part, U64(0))
    total += np.where(short, np.repeat(counts, has), size).astype(U64) * _PLACE[63]
    return mix(total), doc


def distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and how many each text has; values come text by text."""
    if not len(values):
        return values, np.zeros(n_docs, np.int64)
    values = values.copy()
    stop = np.cumsum(np.bincount(doc, minlength=n_docs))
    for a, b in zip(np.concatenate([[0], stop[:-1]]), stop, strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.bincount(doc[new], minlength=n_docs)
