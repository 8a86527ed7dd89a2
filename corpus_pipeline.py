"""The corpus pipeline: STAGES applied one after another to documents, each over all that its predecessor kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the docs of the next.
The first four keep whole rows of documents and all their columns; the last returns the packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictframe.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from verdictframe.llm.cluster import ensure_checkpoint_dir, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold."""
    return quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees, which learn from the labelled rows of all documents."""
    return quality_rules.kept(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return near_dedup.deduplicate(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: a row a bin, with the ids, starts and lengths of its pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("near_dedup", dedup),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", pack),
]

#: Bytes of a row group of what a stage keeps: a task holds one that it reads and one that it writes.
ROW_GROUP_BYTES = 16 << 20

#: SQL can't express the fitted models, the signatures or the packing; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.

    What a stage keeps is written under spark.checkpoint.dir, and removed when the next stage is written.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
