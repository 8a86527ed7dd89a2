"""Runs and experiments kept in a folder: saved as Parquet, JSON or CSV, found by fingerprint, loaded as they were."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.operators.sinks import finite, provenance
from verdictframe.plans.api import Run

FORMATS = ("parquet", "json", "csv")
TABLES = ("scores", "samples")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    names = (s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def write_table(df: DataFrame, path: str, fmt: str, inputs: list[str] = ()) -> None:
    """df as Parquet, strict JSON lines or CSV (nested columns as JSON), with a provenance record beside it."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {', '.join(FORMATS)}")
    if fmt == "json":
        df = finite(df)
    elif fmt == "csv":
        df = df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields))
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    provenance(df, f"{path}.provenance", list(inputs))


class RunStore:
    """Runs under one folder, a sub-folder a fingerprint. Nothing of a run comes to the driver but its name and settings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, fingerprint: str) -> str:
        return f"{self.folder}/fingerprint={fingerprint}"

    def save(self, run: Run, metadata: dict | None = None) -> str:
        at = self._at(run.fingerprint)
        for name in TABLES:
            getattr(run, name).write.mode("overwrite").parquet(f"{at}/{name}")
        about = json.dumps({"name": run.name, "fingerprint": run.fingerprint, "errors": run.errors, "metadata": metadata or {}}, sort_keys=True)
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/about")
        return run.fingerprint

    def __contains__(self, fingerprint: str) -> bool:
        path, system = _path(self.spark, f"{self._at(fingerprint)}/about/_SUCCESS")  # written last
        return system.exists(path)

    def about(self, fingerprint: str) -> dict:
        if fingerprint not in self:
            raise KeyError(fingerprint)
        return json.loads(self.spark.read.text(f"{self._at(fingerprint)}/about").first()["value"])

    def load(self, fingerprint: str) -> Run:
        about = self.about(fingerprint)
        scores, samples = (self.spark.read.parquet(f"{self._at(fingerprint)}/{name}") for name in TABLES)
        return Run(about["name"], fingerprint, samples, scores, about["errors"])

    def get(self, fingerprint: str) -> Run | None:
        return self.load(fingerprint) if fingerprint in self else None

    def fingerprints(self) -> list[str]:
        return [f for f in _names(self.spark, self.folder, "fingerprint=") if f in self]

    def scores(self) -> DataFrame:
        """The scores of all runs, with their fingerprint: one scan, pruned by fingerprint."""
        frames = [self.spark.read.parquet(f"{self._at(f)}/scores").withColumn("fingerprint", F.lit(f)) for f in self.fingerprints()]
        if not frames:
            raise ValueError(f"no runs in {self.folder}")
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def clear(self, fingerprints: Iterable[str] | None = None) -> int:
        """Remove the named runs, or all; how many there were."""
        gone = 0
        for f in list(self.fingerprints() if fingerprints is None else fingerprints):
            path, system = _path(self.spark, self._at(f))
            gone += bool(system.delete(path, True))
        return gone


class ExperimentStore:
    """Experiments: named lists of runs of one RunStore, in their order, with metadata."""

    def __init__(self, runs: RunStore):
        self.runs, self.spark = runs, runs.spark

    def _at(self, name: str) -> str:
        return f"{self.runs.folder}/experiment={name.replace('/', '_').replace(' ', '_')}"

    def save(self, name: str, runs: list[Run], metadata: dict | None = None) -> None:
        for run in runs:
            self.runs.save(run)
        about = json.dumps({"name": name, "runs": [r.fingerprint for r in runs], "metadata": metadata or {}})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(self._at(name))

    def load(self, name: str) -> tuple[list[Run], dict]:
        about = json.loads(self.spark.read.text(self._at(name)).first()["value"])
        return [self.runs.load(f) for f in about["runs"]], about["metadata"]

    def names(self) -> list[str]:
        return _names(self.spark, self.runs.folder, "experiment=")


def rescore(store: RunStore, fingerprint: str, scorers, name: str | None = None) -> Run:
    """A stored run's outputs with other scorers: nothing is generated again, and the fingerprint is a new one."""
    from verdictframe.operators import scoring
    from verdictframe.plans.api import fingerprint as fingerprint_of

    run = store.load(fingerprint)
    scores = scoring.score(run.samples.where("output is not null"), scorers).withColumn("run_id", F.lit(name or run.name))
    return Run(name or run.name, fingerprint_of({"rescored": fingerprint}, scorers), run.samples, scores, run.errors)
