"""What the operators of this subpackage share on the side of the cluster: checkpoints, safe columns, rows of a fold."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdictframe-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: A side of a join with so many short rows at most (some tens of megabytes) may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame) -> tuple[DataFrame, int]:
    """df, cut, and how many rows it has; marked for a broadcast if they are BROADCAST_ROWS at most, else for a shuffle like any other."""
    stored = cut(df)
    n = stored.count()
    return (F.broadcast(stored) if n <= BROADCAST_ROWS else stored), n


#: Bits of a filter of ids (8 MB, whatever there is to filter), and bits of one of its rows (fixed by Spark's functions).
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def held_by(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be among the ids (a column of the same name): few others, and none of these is lost.

    A filter of fixed size, a bit for each hash of an id, is broadcast, so that rows which a join by the key wouldn't use
    aren't shuffled for it. The more ids there are per bit, the more rows pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    row, bit = F.floor(place / ROW_BITS).cast("int"), (place % ROW_BITS).cast("int")
    filters = ids.select(row.alias("row__"), bit.cast("long").alias("bit__")).distinct().groupBy("row__").agg(F.call_function("bitmap_construct_agg", F.col("bit__")).alias("bits__"))
    marked = df.withColumn("at__", row).withColumn("bit__", bit)
    byte = F.conv(F.hex(F.substring("bits__", F.floor(F.col("bit__") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    joined = marked.join(F.broadcast(cut(filters)), F.col("at__") == F.col("row__"))
    return joined.where(F.call_function("getbit", byte, F.col("bit__") % 8) == 1).select(*(F.col(f"`{c}`") for c in df.columns))


BATCH_BYTES = 1 << 20
#: Rows that Parquet's reader decodes at a time: of whole texts, 4,096 take tens of megabytes a task, and their doubling as much again.
READ_ROWS = 512
#: What Spark has where nothing is set.
DEFAULT_BATCH_BYTES, DEFAULT_READ_ROWS = "67108864b", "4096"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches go to Python with no more than BATCH_BYTES each, or with one longer row; a setting of the user's stays.

    Texts are read from Parquet in batches of READ_ROWS, likewise.
    """
    for key, default, bound in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT_BATCH_BYTES, f"{BATCH_BYTES}b"),
        ("spark.sql.parquet.columnarReaderBatchSize", DEFAULT_READ_ROWS, str(READ_ROWS)),
    ):
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input, whatever their names, cannot clash."""
    bound_batches(df.sparkSession)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def keep_rows(documents: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The rows whose text the verdict keeps, as they are: all columns, in the task that reads them, without a join."""
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(at)), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def summed(partials: DataFrame, key: str, value: str, tasks: int = 16) -> dict:
    """Sums of equally long float64 vectors (binary) by a key of few values; each task holds one vector a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), np.float64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "v"])

    out: dict = {}
    spread = partials.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v")).repartition(tasks)
    for k, v in spread.mapInArrow(run, "k string, v binary").collect():
        x = np.frombuffer(v, np.float64)
        out[k] = out[k] + x if k in out else x
    return out
