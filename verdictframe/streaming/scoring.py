"""Scoring of a stream of recorded outputs: an extension, which the library's batch operators share their code with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scorers import Scorer
from verdictframe.operators.scoring import score


def windowed_statistics(samples: DataFrame, scorers: Sequence[Scorer | str], lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """n and mean of each scorer in windows of ts; late samples are taken for so long, repeated ones once.

    samples is a stream, or a batch, with run_id, sample_id, ts and the scorers' columns. Scoring is a projection without state;
    state is held for the sample ids within the lateness, and for the open windows.
    """
    key = ["run_id", "sample_id"]
    once = samples.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(key) if samples.isStreaming else samples.dropDuplicates(key)
    tall = score(once, scorers, ("run_id", "sample_id", "ts"))
    grouped = tall.where("status is null").groupBy(F.window("ts", window), "run_id", "name")
    return grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "run_id", "name", "n", "mean")
