"""Language identification of mixed text: script ranges, per-word scores and Viterbi with a switching penalty.

Learned from texts with a known language: counts of byte trigrams (with word borders) in BUCKETS hashed buckets a
language, summed over all learning rows inside Spark, and the scripts in which each language's letters stand. A
word's script narrows its candidates to the languages that use the script; its score in each of these is the sum of
the log shares of its trigrams. Viterbi with a constant penalty for every change of language labels the words of a
text; it runs over all texts of a batch side by side. A text of more than SEGMENT words is cut into segments, which
run side by side, too: each yields its best scores from each label before it to each at its end, these are chained, and
each segment is then decoded between the labels that the whole path has at its borders. A text longer than a chunk is
walked in pieces, forwards for the scores at their borders and backwards for the labels, so that memory doesn't grow
with a text. Runs of one label are the spans.

Defined results: `und` with score 0 for a null text, one without a letter, or when nothing could be learned; among
languages with equally many words the first in alphabetical order is predicted. Words without letters don't count.
Rows with a null or empty language teach nothing. Further columns are ignored.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import fold, only, summed
from verdictframe.llm.text_kernel import ALNUM, CHUNK_BYTES, LOWER, Words, chunks, split_words, text_buffers

BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
SEGMENT = 512
#: A language uses a script in which at least this share of its letters stands.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

#: First code point of each range, and the script that letters of the range belong to.
SCRIPT_STARTS = [0x0000, 0x0041, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0750, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x2E00, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xE000, 0xF900, 0xFB00, 0xFE00, 0xFE70, 0xFF00, 0xFF21, 0xFF5B, 0xFF66, 0xFFE0, 0x10000, 0x1D000, 0x1D400, 0x1D800, 0x1E000, 0x1F000, 0x20000, 0x40000]
SCRIPT_NAMES = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "arabic", "devanagari", "indic", "thai", "other", "georgian", "hangul", "ethiopic", "latin", "greek", "none", "latin", "other", "none", "kana", "kana", "han", "han", "other", "hangul", "other", "none", "han", "arabic", "none", "arabic", "none", "latin", "none", "kana", "none", "other", "none", "latin", "none", "other", "none", "han", "none"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
_STARTS, _SCRIPT = np.array(SCRIPT_STARTS), np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])
_NONE = SCRIPTS.index("none")
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with the letters of ASCII and of the Latin-1 range in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


def _letters(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The script of each word's first letter, and how many letters each word has (other than in ASCII: characters)."""
    plain = _ASCII_LETTER[data]
    lead = data >= 0xC0
    at = np.flatnonzero(lead)
    follow = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    b = data[at].astype(np.int64)
    three = ((b & 0x0F) << 12) | (follow[0] << 6) | follow[1]
    point = np.where(b < 0xE0, ((b & 0x1F) << 6) | follow[0], np.where(b < 0xF0, three, ((b & 0x07) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2]))
    script = np.full(len(data), _NONE, np.int8)
    script[plain] = SCRIPTS.index("latin")
    script[at] = _SCRIPT[np.searchsorted(_STARTS, point, side="right") - 1]
    script[at[(point == 0xD7) | (point == 0xF7) | ((point >= 0x80) & (point < 0xC0) & (point != 0xAA) & (point != 0xB5) & (point != 0xBA))]] = _NONE
    letter = np.flatnonzero(script != _NONE)
    total = np.concatenate([[0], np.cumsum(script != _NONE)])
    n = total[words.ends] - total[words.starts]
    first = np.full(len(words.starts), _NONE)
    has = np.flatnonzero(n)
    first[has] = script[letter[total[words.starts[has]]]]
    return first, n


def _trigrams(data: np.ndarray, words: Words) -> np.ndarray:
    """The bucket of the trigram around each byte; bytes outside words, and texts' borders, count as a blank."""
    clean = np.where(ALNUM[data], data, 0x20).astype(np.uint32)
    before, after = np.concatenate([[0x20], clean[:-1]]).astype(np.uint32), np.concatenate([clean[1:], [0x20]]).astype(np.uint32)
    full = np.flatnonzero(np.diff(words.offsets))
    before[words.offsets[:-1][full]] = 0x20
    after[words.offsets[1:][full] - 1] = 0x20
    key = before * np.uint32(0x9E3779B1) + clean * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    return ((key * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


def pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at most CHUNK_BYTES of one text, or one longer word, cut where no word goes on."""
    out, lo, limit = [], 0, CHUNK_BYTES
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(~ALNUM[data[lo:hi]])
            while not len(gaps) and hi < len(data):
                step = min(hi + limit, len(data))
                gaps, hi = np.flatnonzero(~ALNUM[data[hi:step]]) + (hi - lo), step
            if hi < len(data) or len(gaps):
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        out.append((lo, hi))
        lo = hi
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, Words]]:
    """The index of the first text, the lowered bytes and the words of each chunk; a text beyond a chunk comes in pieces."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(data, offsets, CHUNK_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        for a, b in pieces(part) if hi == lo + 1 and len(part) > CHUNK_BYTES else [(0, len(part))]:
            lowered = _lowered(part[a:b])
            yield lo, lowered, split_words(lowered, offsets[lo : hi + 1] - offsets[lo] if b - a == len(part) else np.array([0, b - a]), ALNUM)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


def learn(rows: DataFrame) -> Model:
    """The model of the columns text and lang over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for lo, data, words in _parts(batch.column(0)):
                if not len(words.starts):
                    continue
                bucket = _trigrams(data, words)
                script, n = _letters(words, data)
                mine = names[lo : lo + words.n_docs]
                inside = ALNUM[data]
                byte_doc = np.repeat(np.arange(words.n_docs), np.diff(words.offsets))
                for name in set(mine):
                    is_mine = mine == name
                    x = total.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS)))
                    x[:BUCKETS] += np.bincount(bucket[inside & is_mine[byte_doc]], minlength=BUCKETS)
                    x[BUCKETS:] += np.bincount(script[is_mine[words.doc]], weights=n[is_mine[words.doc]], minlength=len(SCRIPTS))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "v"])

    known = only(rows, "text", "lang").where("text is not null and lang is not null and lang <> ''")
    sums = summed(known.mapInArrow(counted, "k string, v binary"), "k", "v")
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    counts = np.stack([sums[x] for x in languages], axis=1)
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    uses |= ~uses.any(1, keepdims=True)  # a script that no language uses narrows nothing
    return Model(languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32), uses)


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of the segments of texts with so many words each."""
    n = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + k * SEGMENT, np.minimum(counts[text] - k * SEGMENT, SEGMENT), text


def _run(scores: np.ndarray, first: np.ndarray, size: np.ndarray, best: np.ndarray, penalty: float, came: np.ndarray | None = None) -> np.ndarray:
    """Scores of the best paths through segments, side by side, on from best (segment x ... x label) before their first word.

    came (word x label) takes the label before each word on the best path to each label. Segments come longest first.
    """
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    best = best.copy()
    own = np.arange(scores.shape[1])
    for t, k in enumerate(active):
        value, at = best[:k], first[:k] + t
        top = value.argmax(-1)
        jump = np.take_along_axis(value, top[..., None], -1) - penalty
        switch = jump > value
        if came is not None:
            came[at] = np.where(switch, top[:, None], own)
        best[:k] = np.where(switch, jump, value) + (scores[at] if value.ndim == 2 else scores[at][:, None])
    return best


def transfers(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """segment x label before (as many as there are labels, and last: none) x label at the end: the best scores."""
    n = scores.shape[1]
    begin = np.full((len(first), n + 1, n), -1e300)
    begin[:, np.arange(n), np.arange(n)] = 0
    begin[:, n] = 0
    order = np.argsort(-size, kind="stable")
    out = np.empty_like(begin)
    out[order] = _run(scores, first[order], size[order], begin[order], penalty)
    return out


def decode(scores: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, last: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of all words of segments between the label before (-1: none) and the last one (-1: the best)."""
    n = scores.shape[1]
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-size, kind="stable")
    first, size, before, last = first[order], size[order], before[order], last[order]
    begin = np.where((before[:, None] < 0) | (before[:, None] == np.arange(n)), 0.0, -1e300)
    came = np.zeros(scores.shape, np.min_scalar_type(n))
    best = _run(scores, first, size, begin, penalty, came)
    state = np.where(last < 0, best.argmax(1), last)
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return labels


def _chain(matrices: np.ndarray, best: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores at the end of a text's segments, and for each but a first one the label before it on the way to each label."""
    came = []
    for m in matrices:
        if best is None:
            best = m[-1]
        else:
            paths = best[:, None] + m[:-1]
            came.append(paths.argmax(0))
            best = paths.max(0)
    return best, came


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; scores (words x labels) come text by text, counts are the texts' words.

    Ties go to staying, then to the first label; at the border of segments, to the first label.
    """
    first, size, text = _segments(counts)
    before, last = np.full(len(first), -1), np.full(len(first), -1)
    several = np.flatnonzero(np.bincount(text, minlength=len(counts))[text] > 1)
    if len(several):
        matrices = transfers(scores, first[several], size[several], penalty)
        at = 0
        while at < len(several):
            n = int((text[several] == text[several[at]]).sum())
            best, came = _chain(matrices[at : at + n], None)
            mine = several[at : at + n]
            last[mine[-1]] = best.argmax()
            for k in range(n - 1, 0, -1):
                before[mine[k]] = last[mine[k - 1]] = came[k - 1][last[mine[k]]]
            at += n
    return decode(scores, first, size, before, last, penalty)


def _scores(data: np.ndarray, words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each word's score in each language (outside a language's scripts: out of the question), and its letters."""
    script, n = _letters(words, data)
    sums = np.zeros((len(data) + 1, len(model.languages)))
    np.cumsum(model.scores[_trigrams(data, words)], axis=0, dtype=np.float64, out=sums[1:])
    own = sums[words.ends] - sums[words.starts]
    own[~model.uses[script]] -= 1e3
    own[n == 0] = 0
    return own.astype(np.float32), n


def _label_long(data: np.ndarray, model: Model) -> np.ndarray:
    """Labels of the words of one text, in pieces: forwards for the scores at their borders, backwards for the labels."""
    parts = pieces(data)

    def scored(k: int) -> tuple[np.ndarray, np.ndarray]:
        part = _lowered(data[parts[k][0] : parts[k][1]])
        return _scores(part, split_words(part, np.array([0, len(part)]), ALNUM), model)

    best, borders = None, []
    for k in range(len(parts)):
        borders.append(best)
        scores, _ = scored(k)
        if len(scores):
            first, size, _ = _segments(np.array([len(scores)]))
            best, _ = _chain(transfers(scores, first, size, SWITCH_PENALTY), best)
            best = best - best.max()
    labels: list[np.ndarray] = []
    state = -1 if best is None else int(best.argmax())
    for k in range(len(parts) - 1, -1, -1):
        scores, letters = scored(k)
        if not len(scores):
            continue
        first, size, _ = _segments(np.array([len(scores)]))
        _, came = _chain(transfers(scores, first, size, SWITCH_PENALTY), borders[k])
        n = len(first)
        last, before = np.full(n, state), np.full(n, -1)
        for i in range(n - 1, -1, -1):
            at = i - (borders[k] is None)
            if at >= 0:
                before[i] = came[at][last[i]]
                if i:
                    last[i - 1] = before[i]
        state = int(before[0])
        found = decode(scores, first, size, before, last, SWITCH_PENALTY)
        found[letters == 0] = -1
        labels.append(found.astype(np.int16))
    return np.concatenate(labels[::-1]) if labels else np.zeros(0, np.int16)


def label_words(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the label of each word (-1 without a letter)."""
    data, offsets = text_buffers(column)
    n = len(column)
    counts, short, long = np.zeros(n, np.int64), [], {}
    scores, letters = [np.zeros((0, len(model.languages)), np.float32)], [np.zeros(0, np.int64)]
    for lo, hi in chunks(data, offsets, CHUNK_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > CHUNK_BYTES:
            long[lo] = _label_long(part, model)
            counts[lo] = len(long[lo])
            continue
        lowered = _lowered(part)
        words = split_words(lowered, offsets[lo : hi + 1] - offsets[lo], ALNUM)
        own, n_letters = _scores(lowered, words, model)
        counts[lo:hi] = words.counts
        short.append(np.arange(lo, hi))
        scores.append(own)
        letters.append(n_letters)
    texts = np.concatenate(short) if short else np.zeros(0, np.int64)
    found = viterbi(np.concatenate(scores), counts[texts])
    found[np.concatenate(letters) == 0] = -1
    if not long:
        return counts, found
    labels, owner = np.zeros(counts.sum(), np.int64), np.repeat(np.arange(n), counts)
    is_long = np.isin(owner, list(long))
    labels[~is_long] = found
    labels[is_long] = np.concatenate([long[k] for k in sorted(long)])
    return counts, labels


def has_letter(text: bytes) -> bool:
    """Whether UTF-8 text has a letter of any script; it is read until the first one."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    return any(any(map(str.isalpha, decoder.decode(text[i : i + 4096]))) for i in range(0, len(text), 4096))


def _written(column: pa.Array) -> np.ndarray:
    """Which texts have a letter: those with one of ASCII, and of the others those that has_letter() says."""
    data, offsets = text_buffers(column)
    found = np.zeros(len(column), bool)
    for lo, hi in chunks(data, offsets, CHUNK_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
        found[lo:hi] = np.diff(plain[offsets[lo : hi + 1] - offsets[lo]]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
    return found


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in batches:
            n = batch.num_rows
            lang, score = [UNDETERMINED] * n, np.zeros(n)
            if k:
                counts, labels = label_words(batch.column(1), model)
                doc = np.repeat(np.arange(n), counts)
                votes = np.bincount(doc[labels >= 0] * k + labels[labels >= 0], minlength=n * k).reshape(n, k)
                total, best = votes.sum(1), votes.argmax(1)
                written = _written(batch.column(1))
                lang = [model.languages[b] if w else UNDETERMINED for b, w in zip(best, written, strict=True)]
                score = np.where(written, votes[np.arange(n), best] / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _spanned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, labels = label_words(batch.column(1), model) if model.languages else (np.zeros(batch.num_rows, np.int64), np.zeros(0, np.int64))
            doc = np.repeat(np.arange(batch.num_rows), counts)
            place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
            keep = labels >= 0
            doc, place, labels = doc[keep], place[keep], labels[keep]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(doc))[: len(at)] - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[at])), pa.array(place[at]), pa.array(place[last] + 1), pa.array([model.languages[x] for x in labels[at]], pa.string())],
                names=["doc_id", "start_word", "end_word", "lang"],
            )

    return run


def learned_fold() -> Column:
    """Rows from which the languages may be learned: those whose crc32(doc_id) mod 3 isn't 1."""
    return fold("doc_id", 3) != 1


def spans(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and lang of each run of words in one language."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return only(documents, "doc_id", "text").mapInArrow(_spanned(model), f"doc_id {kind}, start_word long, end_word long, lang string")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred (the language of most words) and score (their share)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = only(documents, "doc_id", "text").mapInArrow(_predicted(model), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def predict(documents: DataFrame) -> DataFrame:
    """identify() with a model learned from the rows of documents that may be learned from."""
    return identify(documents, learn(documents.where(learned_fold())))
