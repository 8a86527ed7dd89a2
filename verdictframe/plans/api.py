"""The front door: evaluate datasets, generate outputs, compare runs, and keep runs by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.identity import code_of
from verdictframe.functions.scorers import SCORERS, Scorer
from verdictframe.operators import comparison as C
from verdictframe.operators import scoring as R
from verdictframe.operators.judges import Model, ask


def echo() -> Model:
    return lambda prompts: list(prompts)


def scripted(replies: Mapping[str, str], otherwise: str = "") -> Callable[[], Model]:
    """A model that answers from a table of prompts."""
    table = dict(replies)
    return lambda: lambda prompts: [table.get(p, otherwise) for p in prompts]


def default_scorers(samples: DataFrame) -> list[str]:
    """exact_match if some sample has a target, else none."""
    return ["exact_match"] if samples.where("target is not null").head(1) else []


def fingerprint(config: Mapping, scorers: Sequence[Scorer | str], judges: Sequence[dict] = ()) -> str:
    """16 hex digits that change with any setting that affects scores; the order of scorers is one. judges are their identity()s."""
    names = [SCORERS[s] if isinstance(s, str) else s for s in scorers]
    identity = {"config": dict(config), "scorers": [[s.name, s.direction, list(s.arguments), list(s.required), code_of(s.build)] for s in names]} | ({"judges": list(judges)} if judges else {})
    return hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass
class Run:
    """A finished run: its tall scores, and everything else as queries over them."""

    name: str
    fingerprint: str
    samples: DataFrame
    scores: DataFrame
    errors: dict[str, str] = field(default_factory=dict)

    def statistics(self) -> DataFrame:
        return R.statistics(self.scores, "name")

    def predictions(self) -> DataFrame:
        return self.samples.join(R.correctness(self.scores, "sample_id"), "sample_id", "left")

    def unscored(self) -> DataFrame:
        return R.unscored(self.scores, "name")

    def save(self, path: str) -> None:
        """Scores as one partition of a table of runs."""
        self.scores.write.mode("overwrite").parquet(f"{path}/fingerprint={self.fingerprint}")


def generate(samples: DataFrame, model: Callable[[], Model], prompt: str = "input") -> DataFrame:
    """samples with output and error: what the model answers to the prompts; a given actual_output is kept."""
    asked = ask(samples.withColumn("prompt__", F.col(prompt)), model, "prompt__").withColumnRenamed("reply", "generated__").drop("prompt__")
    output = F.coalesce("actual_output", "generated__") if "actual_output" in samples.columns else F.col("generated__")
    return asked.withColumn("output", output).drop("generated__")


def evaluate(samples: DataFrame, scorers: Sequence[Scorer | str] | None = None, model: Callable[[], Model] | None = None, name: str = "run", limit: int | None = None, config: Mapping | None = None) -> Run:
    """Score samples with recorded outputs (actual_output), or with a model's.

    limit keeps the first rows in the order of row_no. Samples without an output are left out of the scores.
    """
    rows = samples if limit is None else samples.where(F.col("row_no") < limit)
    rows = generate(rows, model) if model else rows.withColumn("output", F.col("actual_output"))
    chosen = list(default_scorers(rows) if scorers is None else scorers)
    scores = R.score(rows.where("output is not null"), chosen).withColumn("run_id", F.lit(name))
    return Run(name, fingerprint({"limit": limit, **(config or {})}, chosen), rows, scores)


def evaluate_many(datasets: Mapping[str, DataFrame], scorers: Sequence[Scorer | str] | None = None, on_error: str = "raise", **more) -> dict[str, Run]:
    """A run for each dataset, never blended; a dataset that fails raises, or is left out with on_error='skip'."""
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    runs: dict[str, Run] = {}
    for name, samples in datasets.items():
        try:
            runs[name] = evaluate(samples, scorers, name=name, **more)
        except Exception:
            if on_error == "raise":
                raise
    return runs


def compare(baseline: Run | Sequence[Run], candidate: Run | None = None, metric: str | None = None, warn: float = C.WARN, fail: float = C.FAIL) -> DataFrame:
    """Two runs: their statistics side by side, with the change and its grade. A list of runs: their leaderboard.

    A metric's direction is the first one that the runs' scores say; of a metric named "task:name" it may be that of name.
    """
    if candidate is None:
        return leaderboard(baseline, metric)
    found = C.metric_deltas(baseline.statistics(), candidate.statistics())
    each = [run.scores.select("name", "direction", F.lit(k).alias("k")) for k, run in enumerate((baseline, candidate))]
    graded = C.with_direction(found, C.first_directions(each[0].unionByName(each[1]), "k"))
    return graded.withColumn("grade", C.grade(F.col("delta"), F.col("direction"), warn, fail))


def leaderboard(runs: Sequence[Run], metric: str | None = None) -> DataFrame:
    """A row a run and metric: place, run, fingerprint, name, mean and n, from the best run by a metric (else the first run's first one) to the worst.

    A run that didn't measure it comes last; runs that are equal keep their order.
    """
    if not runs:
        raise ValueError("a leaderboard needs a run")
    rows = None
    for k, run in enumerate(runs):
        own = run.statistics().select(F.lit(k).alias("run_no"), F.lit(run.name).alias("run"), F.lit(run.fingerprint).alias("fingerprint"), "name", "mean", "n")
        rows = own if rows is None else rows.unionByName(own)
    if metric is None:
        first = runs[0].scores.groupBy("name").agg(F.min("score_no").alias("score_no")).orderBy("score_no", "name").first()
        metric = first and first["name"]
    means = rows.groupBy("run_no").agg(F.max(F.when(F.col("name") == F.lit(metric), F.col("mean"))).alias("by"))
    # as many rows as there are runs
    placed = means.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("by"), "run_no")))
    return rows.join(F.broadcast(placed.select("run_no", "place")), "run_no").select("place", "run", "fingerprint", "name", "mean", "n")


def pairwise(runs: Mapping[str, Run], baseline: str, candidate: str, **limits: float) -> DataFrame:
    """compare() of two of several named runs."""
    if missing := [n for n in (baseline, candidate) if n not in runs]:
        raise KeyError(f"no runs named {', '.join(missing)}; there are {', '.join(runs)}")
    return compare(runs[baseline], runs[candidate], **limits)


@dataclass
class Experiment:
    """Runs in the order in which they were added."""

    name: str
    runs: list[Run] = field(default_factory=list)

    def add(self, run: Run) -> None:
        self.runs.append(run)

    def pairwise_diff(self, a: int = 0, b: int = -1) -> DataFrame:
        """compare() of two runs by their places; by default the last against the first."""
        return compare(self.runs[a], self.runs[b])

    def leaderboard(self, metric: str | None = None) -> DataFrame:
        return leaderboard(self.runs, metric)


def compare_models(samples: DataFrame, models: Mapping[str, Callable[[], Model]], scorers: Sequence[Scorer | str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Statistics of each model's run with a model column, and the errors of models that failed."""
    out, errors = None, {}
    for name, model in models.items():
        try:
            stats = evaluate(samples, scorers, model, name).statistics().withColumn("model", F.lit(name))
            out = stats if out is None else out.unionByName(stats)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {e}"
    return out, errors
