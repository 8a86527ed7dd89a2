"""Filter interaction audit: what each of five quality filters removes, in every order in which they can be applied.

Filters, by letter: A too few words, B too many repeated words, C too many capitals, D symbols, E a text that a smaller
doc_id has already. Each document is reduced to a mask of the filters it fails; masks are counted per part (language),
so that what follows depends on the number of parts alone. The cells (part, mask) are unpivoted against the steps of
all 120 orders, a running bit-or over a cell's earlier steps tells what was removed before, conditional sums give the
figures of each step, and a window over part and filter adds up what a filter removes in all orders.

The only shuffles of rows carry ids and digests. First texts are minima per digest, combined before the shuffle, and
are joined back by digest and id together, so a text that a third of the rows share is no hot key.

Defined results: a null text counts as an empty one (fails A and nothing else, and E if a smaller id has an empty text,
too), a null language as the part ''. A row without an id fails no E, makes no other row fail it, and has no label. A
repeated row counts as often as it comes; rows with the same id and text are no copies of each other. Of several labels
of an id, any 1 counts. An empty table has no parts and no rows. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, only

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
#: Characters of filter D, and white space.
SYMBOLS, SPACE = "[#$%&*|]", r"[\x20\x09-\x0D]+"


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def masks(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, part, mask (of the filters A to D) and digest of the text."""
    text = F.coalesce("text", F.lit(""))
    cut_up = only(documents, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.split(text, SPACE).alias("pieces"))
    # only the first and the last piece can be empty
    empty = lambda at: F.when(F.element_at("pieces", at) == "", 1).otherwise(0)
    n_empty = empty(1) + F.when(F.size("pieces") > 1, empty(-1)).otherwise(0)
    counted = cut_up.select(
        "doc_id",
        "part",
        (F.size("pieces") - n_empty).cast("long").alias("words"),
        (F.size(F.array_distinct("pieces")) - F.least(n_empty, F.lit(1))).cast("long").alias("distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("upper"),
        F.length("text").cast("long").alias("chars"),
        F.col("text").rlike(SYMBOLS).alias("symbols"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    mask = (
        _bit("A", F.col("words") < MIN_WORDS)
        + _bit("B", 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"))
        + _bit("C", 100 * F.col("upper") > UPPER_PERCENT * F.col("chars"))
        + _bit("D", F.col("symbols"))
    )
    return counted.select("doc_id", "part", mask.alias("mask"), "digest")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of all five filters) and how many documents it has: n, good and toxic."""
    rows = cut(masks(documents))
    firsts = rows.groupBy(F.col("digest").alias("first_digest")).agg(F.min("doc_id").alias("first_id"))
    marked = only(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = rows.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left").join(marked, F.col("doc_id") == F.col("labelled"), "left")
    later = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return joined.groupBy("part", (F.col("mask") + _bit("E", later)).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def interactions(found: DataFrame) -> DataFrame:
    """The figures of every part, order and step, from cells()."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    long_form = found.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    bit = F.element_at(F.create_map(*(x for c in FILTERS for x in (F.lit(c), F.lit(1 << FILTERS.index(c))))), letter)
    steps = long_form.withColumn("filter", letter).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    walk = Window.partitionBy("part", "mask", "filter_order").orderBy("step")
    before = F.coalesce(F.bit_or("fails").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = steps.withColumn("before", before)
    here, gone = (F.col("fails") > 0) & (F.col("before") == 0), (F.col("fails") > 0) & (F.col("before") > 0)

    def total(which: Column, what: str = "n") -> Column:
        return F.sum(F.when(which, F.col(what)).otherwise(0)).cast("long")

    figures = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("before").bitwiseOR(F.col("fails")) == 0).alias("kept"),
        total(here).alias("removed"),
        total(gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return interactions(cells(documents, labels))
