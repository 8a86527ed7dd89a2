"""Splits, limits and picks: which rows of a dataset take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.operators.cluster import cut

PARTS = ("train", "val", "test")


def ordinal(df: DataFrame, *order: str) -> DataFrame:
    """df with row_no, the place of each row (from 0) in the order of the columns.

    Rows are range-partitioned, counted by partition (a small table, broadcast) and numbered within each, so no task
    holds them all. The partitions are written once: read again, their borders, which are drawn from a sample, could
    lie elsewhere. Equal rows may change places.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(spread.withColumn("id__", F.monotonically_increasing_id()))
    part, place = F.shiftright("id__", 33).cast("int"), F.col("id__").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part__", before.alias("start__"))
    numbered = marked.withColumn("part__", part).withColumn("place__", place).join(F.broadcast(starts), "part__")
    return numbered.withColumn("row_no", F.col("start__") + F.col("place__")).drop("id__", "part__", "place__", "start__")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order of the columns."""
    return df.orderBy(*order).limit(n)


def first_share(df: DataFrame, share: float, *order: str) -> DataFrame:
    """The first rows in the order of the columns, floor(share * n) of them."""
    n = int(df.count() * share)
    return ordinal(df, *order).where(F.col("row_no") < n).drop("row_no")


def _part(i: Column, n: Column, shares: Sequence[float]) -> Column:
    """train, val or test by place, with floor(share * n) rows for the first two."""
    train, val = F.floor(n * shares[0]), F.floor(n * shares[1])
    return F.when(i < train, PARTS[0]).when(i < train + val, PARTS[1]).otherwise(PARTS[2])


def sequential_split(df: DataFrame, shares: Sequence[float], *order: str) -> DataFrame:
    """df with split: the first rows are train, the next val, the rest test."""
    n = df.count()
    return ordinal(df, *order).withColumn("split", _part(F.col("row_no"), F.lit(n), shares)).drop("row_no")


def random_split(df: DataFrame, shares: Sequence[float], *key: str, seed: int = 42) -> DataFrame:
    """df with split, the rows being ordered by a seeded hash of the key: the same rows always fall the same way."""
    hashed = df.withColumn("hash__", F.xxhash64(F.lit(seed), *key))
    return sequential_split(hashed, shares, "hash__", *key).drop("hash__")


def group_ordinal(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """df with place (from 0, in the order of the columns, in its group of by) and size (of the group).

    Rows are range-partitioned by group and order together, so a group of any size is dealt over as many tasks as it
    fills. Each task numbers its rows by group; counts per task and group, and their running sums over the tasks, are a
    small table that gives each task's numbers their start. No task holds a group. The partitions are written once, as
    in ordinal(). Null is a group, too; equal rows may change places.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    sort = [*(F.col(c).asc_nulls_first() for c in by), *keys]
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    marked = cut(spread.withColumn("id__", F.monotonically_increasing_id()))
    task = F.shiftright("id__", 33).cast("int")
    counts = marked.groupBy(*by, task.alias("task__")).agg(F.count(F.lit(1)).alias("n__"), F.min("id__").alias("first__"))
    own = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n__").over(own.orderBy("task__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"{c}__") for c in by), F.col("task__").alias("start_task__"), (before - F.col("first__")).alias("shift__"), F.sum("n__").over(own).alias("size"))
    same = task == F.col("start_task__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    joined = marked.join(F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts, same)
    return joined.withColumn("place", F.col("id__") + F.col("shift__")).drop("id__", "shift__", "start_task__", *(f"{c}__" for c in by))


#: The starts of so many pairs of group and task may be broadcast; beyond that they are shuffled.
BROADCAST_STARTS = 100_000


def stratified_split(df: DataFrame, shares: Sequence[float], stratum: str, *order: str) -> DataFrame:
    """df with split, in the order of the columns, with the shares in each stratum; a stratum may fill many tasks."""
    placed = group_ordinal(df, [stratum], *order)
    return placed.withColumn("split", _part(F.col("place"), F.col("size"), shares)).drop("place", "size")


#: Up to so many rows a group, each task keeps its own first rows before any are shuffled (Spark's limit for that).
GROUP_LIMIT = 1000


def limit_per_group(df: DataFrame, by: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group, with their place (from 1).

    A small n is taken before the shuffle, so that a group sends n rows a task at most; beyond GROUP_LIMIT the groups
    are numbered by as many tasks as they fill.
    """
    if n > GROUP_LIMIT:
        placed = group_ordinal(df, by, *order)
        return placed.where(F.col("place") < n).drop("size").withColumn("place", F.col("place") + 1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def last_turns(messages: DataFrame, by: str, order: str, roles: Sequence[str]) -> DataFrame:
    """The last text of each role in each conversation, as a column last_<role>."""

    def last(role: str) -> Column:
        mine = F.col("role") == role
        return F.max_by(F.when(mine, F.col("text")), F.when(mine, F.col(order))).alias(f"last_{role}")

    return messages.groupBy(by).agg(*map(last, roles))


def turn_pairs(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, turn, answer_turn, input and output: each user turn that an assistant turn follows at once."""
    w = Window.partitionBy(by).orderBy("turn")
    rows = messages.select(by, "turn", "role", F.col("text").alias("input"), *(F.lead(c).over(w).alias(f"next_{c}") for c in ("turn", "role", "text")))
    pairs = rows.where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1")
    return pairs.select(by, "turn", F.col("next_turn").alias("answer_turn"), "input", F.col("next_text").alias("output"))


def answer_index(letter: Column, letters: str = "ABCD") -> Column:
    """0-based place of an answer's letter; a letter outside them raises."""
    at = F.instr(F.lit(letters), F.upper(F.trim(letter)))
    valid = (F.length(F.trim(letter)) == 1) & (at > 0)
    return F.when(valid, (at - 1).cast("long")).when(letter.isNotNull(), F.raise_error(F.concat(F.lit("not an answer letter: "), letter)).cast("long"))
