"""Samples from a function: a data source whose partitions are read in the executors, each time the table is read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verdictframe.functions.identity import code_of

#: So many rows go to the JVM at once.
BATCH_ROWS = 4096


class Part(InputPartition):
    """One of the values that a source is called with."""

    def __init__(self, value):
        super().__init__(value)


def source_name(rows: Callable, parts: Sequence, schema: str) -> str:
    """A name that follows from what the function does, where it is called and what it yields; where it stands doesn't matter."""
    says = json.dumps([code_of(rows), list(parts), schema], sort_keys=True, default=str)
    return f"callable_{hashlib.sha256(says.encode()).hexdigest()[:12]}"


def register(spark: SparkSession, rows: Callable[[object], Iterable[tuple | dict | pa.RecordBatch]], parts: Sequence = (None,), schema: str = "input string, target string", name: str | None = None) -> str:
    """Register a source that calls rows(part) for each of parts, and the name to read it by.

    rows yields tuples, mappings by column, or Arrow batches; it runs in the executors, a task a part, and again at
    every read. Missing keys and short rows are refused, so that no column is silently empty.
    """
    own, values, wanted = name or source_name(rows, parts, schema), list(parts), StructType.fromDDL(schema)
    arrow = to_arrow_schema(wanted)

    def batches(part) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in rows(part):
            if isinstance(row, pa.RecordBatch):
                yield row.cast(arrow)
                continue
            names = arrow.names
            if isinstance(row, dict):
                if missing := [n for n in names if n not in row]:
                    raise ValueError(f"a row of {own} lacks {', '.join(missing)}")
                held.append({n: row[n] for n in names})
            else:
                held.append(dict(zip(names, row, strict=True)))
            if len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(v) for v in values]

        def read(self, partition):
            yield from batches(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return own

        def schema(self):
            return wanted

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return own


def from_callable(spark: SparkSession, rows: Callable, parts: Sequence = (None,), schema: str = "input string, target string", name: str | None = None) -> DataFrame:
    """The rows of a function as a table."""
    return spark.read.format(register(spark, rows, parts, schema, name)).load()
