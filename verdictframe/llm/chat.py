"""Chat formatting: a hidden Markov model over line features recovers the turns of raw transcripts.

A state is a role and whether the line begins a turn or goes on with it. A line shows a speaker marker (or none), a
length, whether it ends in a question mark and whether a blank line stands before it. Transitions and emissions are
counted over transcripts whose turns are known, summed inside Spark (one vector of fixed size a task), and smoothed
by one. Viterbi labels the lines of a transcript, and turns are rendered in one canonical form.

A conversation is one transcript, however long. It is stored in blocks of BLOCK_TURNS turns, and the Viterbi path runs
through all of them: each block of a longer conversation yields the best scores from each state before it to each
state at its end (a small matrix), the matrices of a conversation are chained in a stream that holds a few bytes a
block, and each block is then decoded between the two states that the whole path has at its borders. So a block's row
is the same as if the conversation had been decoded in one piece, and no task holds a long conversation.

Defined results: a null, empty or blank transcript has no turns and renders as an empty text. A marker alone on its
line begins a turn whose text follows. Ties go to the first state. Repeated transcripts each get a row. Turns of a null
conv_id are one conversation; a null turn number comes first; turns of equal number stand in the order of role and
text; where turn numbers repeat so often that a block has more than BLOCK_ROWS rows, it is cut by a hash. A turn with a
null or blank text is a turn without lines. Roles other than the three are "other". Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import broadcast_if_small, only, summed

ROLES = ["system", "user", "assistant", "other"]
#: Names under which speakers of each role are announced.
NAMES = {"system": ["system", "instructions"], "user": ["user", "human", "question", "q"], "assistant": ["assistant", "ai", "bot", "answer", "a"], "other": ["tool", "function", "developer", "narrator"]}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_WORD = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|({_WORD})\|>|\[({_WORD})\]|#+\s*({_WORD})\s*:?(?=\s|$)|({_WORD})\s*:)\s*", re.I)
_OTHER_SPEAKER = re.compile(r"\s*[A-Z][\w .-]{0,30}:\s")
NO_MARKER, OTHER = len(ROLES), len(ROLES) + 1
#: Number of values of each line feature: marker, length, question, blank line before.
WIDTHS = [len(ROLES) + 2, 6, 2, 2]
STATES = 2 * len(ROLES)  # role, and role + len(ROLES) for a line that goes on
BLOCK_TURNS, BLOCK_ROWS = 64, 256


@dataclass
class Model:
    start: np.ndarray
    transition: np.ndarray
    emission: list[np.ndarray]


def observe(text: str) -> tuple[list[str], np.ndarray]:
    """The lines of a transcript that aren't blank, without their markers, and their features."""
    lines, features, blank = [], [], False
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        marker, rest = NO_MARKER, line
        if m := _MARKER.match(line):
            marker, rest = _ROLE_OF[next(g for g in m.groups() if g).lower()], line[m.end() :]
        elif _OTHER_SPEAKER.match(line):
            marker = OTHER
        n = len(rest)
        features.append((marker, 0 if n == 0 else min(5, 1 + int(np.log2(1 + n / 40))), int(rest.rstrip().endswith("?")), int(blank)))
        lines.append(rest)
        blank = False
    return lines, np.array(features, np.int64).reshape(-1, len(WIDTHS))


SIZE = STATES + STATES * STATES + sum(WIDTHS) * STATES


def _counts(states: np.ndarray, features: np.ndarray, first: bool) -> np.ndarray:
    parts = [np.bincount(states[: int(first)], minlength=STATES), np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)]
    parts += [np.bincount(states * w + features[:, k], minlength=STATES * w) for k, w in enumerate(WIDTHS)]
    return np.concatenate(parts).astype(float)


def model_of(counts: np.ndarray) -> Model:
    """Smoothed log shares of the summed counts."""

    def shares(x: np.ndarray) -> np.ndarray:
        return np.log((x + 1) / (x + 1).sum(-1, keepdims=True))

    at = STATES + STATES * STATES
    emission = []
    for w in WIDTHS:
        emission.append(shares(counts[at : at + STATES * w].reshape(STATES, w)))
        at += STATES * w
    return Model(shares(counts[:STATES]), shares(counts[STATES : STATES + STATES * STATES].reshape(STATES, STATES)), emission)


def seen(features: np.ndarray, model: Model) -> np.ndarray:
    """The log share of each line's features in each state."""
    return sum(e[:, features[:, k]].T for k, e in enumerate(model.emission))


def viterbi(features: np.ndarray, model: Model, before: int | None = None, last: int | None = None) -> np.ndarray:
    """The likeliest states of lines: of a whole transcript, or behind a state and up to a given last one."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int64)
    shares = seen(features, model)
    best = (model.start if before is None else model.transition[before]) + shares[0]
    came = np.zeros((n, STATES), np.int8)
    for t in range(1, n):
        paths = best[:, None] + model.transition
        came[t] = paths.argmax(0)
        best = paths[came[t], np.arange(STATES)] + shares[t]
    states = np.zeros(n, np.int64)
    states[-1] = best.argmax() if last is None else last
    for t in range(n - 1, 0, -1):
        states[t - 1] = came[t, states[t]]
    return states


def transfer(features: np.ndarray, model: Model) -> np.ndarray:
    """The best score of lines that end in each state: behind each state (rows), and at the start (last row)."""
    shares = seen(features, model)
    best = np.concatenate([model.transition, model.start[None]]) + shares[0]
    for t in range(1, len(shares)):
        best = (best[:, :, None] + model.transition).max(1) + shares[t]
    return best


def turns_of(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of the turns that the states begin; a role that changes without a beginning begins one, too."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        role = ROLES[state % len(ROLES)]
        if state < len(ROLES) or not turns or turns[-1][0] != role:
            turns.append((role, []))
        turns[-1][1].append(line)
    return [(role, "\n".join(x for x in text if x).strip()) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form of a conversation."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


@dataclass
class Transcript:
    """Turns as people paste them: lines and features as observe() gives them, and the states that the known turns give to the lines."""

    text: str
    lines: list[str]
    features: np.ndarray
    states: np.ndarray
    truth: list[tuple[str, str]]


def raw_transcript(conv_id: int | None, turns: list[tuple[int | None, str | None, str | None]], goes_on: bool = False) -> Transcript:
    """A transcript of known turns (turn, role, text): one marker style a conversation, and some turns without a marker.

    Every third conversation has no blank lines between its turns, and all its markers. The turns it is to be read as
    have their texts stripped of blank lines. goes_on: other turns stand before.
    """
    gap = "\n" if (conv_id or 0) // 8 % 3 == 2 else "\n\n"
    style, pieces, lines, features, states, truth = (conv_id or 0) % 4, [], [], [np.zeros((0, len(WIDTHS)), np.int64)], [], []
    for place, (turn, role, text) in enumerate(turns):
        own = [x for x in (text or "").split("\n") if x.strip()]
        known = role if role in ROLES else "other"
        name = NAMES[known][min((conv_id or 0) // 4 % 2, len(NAMES[known]) - 1)]
        marker = (f"{name.capitalize()}: ", f"### {name.capitalize()}:\n", f"<|{name}|>\n", f"[{name.upper()}] ")[style]
        if own and (place or goes_on) and gap != "\n" and ((conv_id or 0) * 31 + (turn or 0)) % 7 == 0:
            marker = ""
        pieces.append(marker + "\n".join(own))
        mine, observed = observe(pieces[-1])
        observed[:1, 3] = int(gap != "\n" and bool(place or goes_on))
        k = ROLES.index(known)
        lines += mine
        features.append(observed)
        states += [k] + [k + len(ROLES)] * (len(mine) - 1)
        truth.append((known, "\n".join(own).strip()))
    return Transcript(gap.join(pieces), lines, np.concatenate(features), np.array(states, np.int64), truth)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, block, part and turns (turn, role, text) of conversations, in blocks of BLOCK_TURNS turns."""
    rows = only(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1 << 40)).cast("long"))
    crowded = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    crowded, n = broadcast_if_small(crowded)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    parted = rows.join(crowded, same, "left") if n else rows.withColumn("parts", F.lit(None).cast("long"))
    part = F.coalesce(F.pmod(F.xxhash64("turn", "role", "text", F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("long").alias("part")
    turn = F.struct("turn", "role", "text")
    return parted.select("conv_id", "block", part, turn.alias("x")).groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list("x")).alias("turns"))


def _blocks(batch: pa.RecordBatch, goes_on: Callable[[int], bool]) -> Iterator[tuple[int, Transcript]]:
    for i, (conv_id, turns) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True)):
        yield i, raw_transcript(conv_id, [(t["turn"], t["role"], t["text"]) for t in turns], goes_on(i))


def learn(known: DataFrame) -> Model:
    """The model over all blocks of known (columns of transcripts())."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE)
        for batch in batches:
            first = [b <= 0 for b in batch.column("block").to_pylist()]
            for i, t in _blocks(batch, lambda i: not first[i]):
                if len(t.lines):
                    total += _counts(t.states, t.features, first[i])
        yield pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    return model_of(summed(known.mapInArrow(counted, "k string, v binary"), "k", "v").get("sum", np.zeros(SIZE)))


TURNS = "turns array<struct<role:string, text:string>>, rendered string"


def parse(raw: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """raw with turns and rendered: the turns recovered from its transcripts, and their canonical form."""
    at = raw.columns.index(text)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(at).to_pylist():
                lines, features = observe(x or "")
                found.append(turns_of(lines, viterbi(features, model)))
            turns = pa.array([[{"role": r, "text": t} for r, t in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, turns, pa.array([render(f) for f in found], pa.string())], names=[*batch.schema.names, "turns", "rendered"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields), TURNS])
    return raw.mapInArrow(run, schema)


BORDER = "conv_id long, block long, part long, before int, last int"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of blocks, whose matrices come conversation by conversation, in order."""
    held: list[tuple] = []
    best, came, key = None, [], None

    def found() -> pa.RecordBatch:
        ends = [int(best.argmax())]
        for c in reversed(came):
            ends.append(int(c[ends[-1]]))
        ends = ends[::-1]
        columns = [pa.array([key] * len(held), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*held, strict=True)), pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "part", "before", "last"])

    for batch in batches:
        for conv_id, block, part, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m = np.frombuffer(matrix).reshape(STATES + 1, STATES)
            if not held or conv_id != key:
                if held:
                    yield found()
                held, best, came, key = [], m[-1], [], conv_id
            else:
                paths = best[:, None] + m[:-1]
                came.append(paths.argmax(0).astype(np.int8))
                best = paths.max(0)
            held.append((block, part))
    if held:
        yield found()


def path_borders(blocks: DataFrame, model: Model) -> DataFrame:
    """conv_id, block, part, before and last: the states around the blocks of conversations with several blocks."""
    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "part")).alias("first")).where("n > 1").withColumnRenamed("conv_id", "c")
    several, _ = broadcast_if_small(several)
    longer = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("goes_on", F.struct("block", "part") != F.col("first")).select("conv_id", "block", "part", "turns", "goes_on")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goes_on = batch.column("goes_on").to_pylist()
            found = [transfer(t.features, model).tobytes() for _, t in _blocks(batch, lambda i: goes_on[i])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["conv_id", "block", "part", "matrix"])

    rows = longer.mapInArrow(matrices, "conv_id long, block long, part long, matrix binary")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_chained, BORDER)


def recovered(blocks: DataFrame, model: Model) -> DataFrame:
    """Per block of a conversation, rendered as part of a raw transcript and parsed again: what was recovered of its turns.

    conv_id, block, part, n_lines, n_turns, n_found, lines_right, turns_right, goes_on (the first turn found goes on
    with the last one of the block before), turns and rendered.
    """
    around = path_borders(blocks, model).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("part").alias("p"), "before", "last")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("part") == F.col("p"))
    around, _ = broadcast_if_small(around)
    placed = blocks.join(around, same, "left").select("conv_id", "block", "part", "turns", "before", "last")
    names = ["conv_id", "block", "part", "n_lines", "n_turns", "n_found", "lines_right", "turns_right", "goes_on", "turns", "rendered"]
    kinds = [pa.int64()] * 8 + [pa.bool_(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, around = [], list(zip(*(batch.column(k).to_pylist() for k in ("conv_id", "block", "part", "before", "last")), strict=True))
            for i, t in _blocks(batch, lambda i: around[i][3] is not None):
                conv_id, block, part, before, last = around[i]
                own = viterbi(t.features, model, before, last)
                turns = turns_of(t.lines, own)
                goes_on = before is not None and len(own) > 0 and own[0] == before % len(ROLES) + len(ROLES)
                right = int((own % len(ROLES) == t.states % len(ROLES)).sum())
                same = sum((Counter(turns) & Counter(t.truth)).values())
                rows.append((conv_id, block, part, len(t.lines), len(t.truth), len(turns), right, same, bool(goes_on), [{"role": r, "text": x} for r, x in turns], render(turns)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return placed.mapInArrow(run, "conv_id long, block long, part long, n_lines long, n_turns long, n_found long, lines_right long, turns_right long, goes_on boolean, turns array<struct<role:string, text:string>>, rendered string")


def held_out(conv_id: str = "conv_id") -> Column:
    """Conversations that teach nothing: those whose crc32(conv_id) mod 5 is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(conv_id).cast("string")), F.lit(5)) == 0, F.lit(False))
