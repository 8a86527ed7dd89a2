"""Metrics of one's own that yield several scores: a class becomes a table function, met with samples by a lateral join.

Rows travel in Arrow batches. (A table function over whole batches can't stand in a lateral join in this Spark version.)
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.errors import MetricError
from verdictframe.functions.scorers import MAXIMIZE, MINIMIZE
from verdictframe.functions.structured import field_scores


class Metric:
    """Subclass with a direction (or directions by score), the columns it reads, and score().

    score() takes the columns' values of one sample and yields (name, value) pairs: none for a sample that the metric
    doesn't apply to, a null value for one that couldn't be measured. A sample without a required column isn't scored.
    """

    name = "metric"
    columns: tuple[str, ...] = ("output", "target")
    required: tuple[str, ...] = ()
    direction: str | dict[str, str]

    def __init_subclass__(cls, **more):
        super().__init_subclass__(**more)
        if cls.__dict__.keys() & {"score", "direction", "columns", "required"}:  # unpickling makes a bare class first
            cls._check()

    def __new__(cls, *args, **more):
        cls._check()
        return super().__new__(cls)

    @classmethod
    def _check(cls) -> None:
        said = getattr(cls, "direction", None)
        if not said or any(d not in (MAXIMIZE, MINIMIZE) for d in (said.values() if isinstance(said, dict) else [said])):
            raise MetricError(f"{cls.__name__} must say its direction: {MAXIMIZE!r}, {MINIMIZE!r}, or a map of these by score")
        if unknown := set(cls.required) - set(cls.columns):
            raise MetricError(f"{cls.__name__} requires columns that it doesn't read: {', '.join(sorted(unknown))}")

    def score(self, *values) -> Iterable[tuple[str, float | None]]:
        raise NotImplementedError

    def direction_of(self, name: str) -> str:
        if isinstance(self.direction, str):
            return self.direction
        if name not in self.direction:
            raise MetricError(f"{type(self).__name__} yields {name!r}, of which it says no direction")
        return self.direction[name]

    def table_function(self):
        """The table function of this metric: a row a score."""
        metric, needed = self, [self.columns.index(c) for c in self.required]

        @F.udtf(returnType="name string, value double, direction string", useArrow=True)
        class Scores:
            def eval(self, *row):
                if any(row[k] is None for k in needed):
                    return
                for name, value in metric.score(*row):
                    yield name, None if value is None else float(value), metric.direction_of(name)

        return Scores

    def scores(self, samples: DataFrame, keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
        """Tall scores of samples: the kept columns, name, value, direction and status."""
        call = self.table_function()
        read = samples.select(*keep, *(F.col(c).alias(f"arg{k}__") for k, c in enumerate(self.columns)))
        tall = read.lateralJoin(call(*(F.col(f"arg{k}__").outer() for k in range(len(self.columns)))))
        return tall.select(*keep, "name", "value", "direction").withColumn("status", F.when(F.col("value").isNull() | F.isnan("value"), F.lit("unknown")))


class FieldScores(Metric):
    """F1, precision and recall of the leaves of two JSON texts, from one call."""

    name, direction, required = "field_scores", MAXIMIZE, ("target",)

    def score(self, output, target):
        return zip(("field_f1", "field_precision", "field_recall"), field_scores(output, target), strict=True)
