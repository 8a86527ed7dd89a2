"""Where lineage is cut (checkpoints in the folder that all executors share), and how rows are dealt to tasks and batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df as it was computed once, in the folder that spark.checkpoint.dir names; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdictframe-checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys to as many tasks as a shuffle has, two a core at least.

    The number is stated, since adaptive execution else merges small partitions into a few tasks: rows that take long, or
    that become many, would then run on some cores alone, and a task would hold far more than its share.
    """
    session = df.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


#: Arrow batches of whole texts and of whole episodes.
BATCH_BYTES = 1 << 20
#: Fixed value: what Spark has where nothing is set.
DEFAULT_BATCH_BYTES = "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches go to Python with no more than BATCH_BYTES each, or with one longer row; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
