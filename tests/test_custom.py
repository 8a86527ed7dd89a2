"""Sources, metrics and models of one's own."""

import random
import time

import pytest

from verdictframe.errors import MetricError, RegistryError
from verdictframe.functions.metrics import FieldScores, Metric
from verdictframe.functions.structured import field_scores
from verdictframe.operators.scoring import statistics
from verdictframe.plans.registry import query
from verdictframe.sources.callables import from_callable, register, source_name


def test_a_changing_function_is_called_at_every_read(spark):
    def rows(part):
        for k in range(3):
            yield f"{part}-{k}", str(random.random())

    df = from_callable(spark, rows, ["a", "b", "c"])
    assert df.rdd.getNumPartitions() == 3 and df.count() == 9
    first, second = ({r.input: r.target for r in df.collect()} for _ in range(2))
    assert first.keys() == second.keys() and first != second


def test_rows_of_a_callable_may_be_mappings_and_many(spark):
    df = from_callable(spark, lambda part: ({"b": None, "a": k} for k in range(part)), [0, 10_000, 1], "a long, b string")
    assert sorted(r.a for r in df.collect()) == sorted([*range(10_000), 0])


@pytest.mark.parametrize("row", [("only one",), ("a", "b", "c"), {"input": "a"}])
def test_rows_that_lack_columns_are_refused(spark, row):
    with pytest.raises(Exception, match="lacks target|zip"):
        from_callable(spark, lambda part: [row]).collect()


def test_source_names_follow_from_what_the_function_does(spark):
    def make(n):
        return lambda part: [("a", str(n))]

    assert source_name(make(1), [1], "s") == source_name(make(1), [1], "s")
    assert len({source_name(make(1), [1], "s"), source_name(make(2), [1], "s"), source_name(make(1), [2], "s"), source_name(make(1), [1], "t")}) == 4
    assert register(spark, make(1), name="own_rows") == "own_rows"
    assert spark.read.format("own_rows").load().first().target == "1"


def test_a_metric_without_direction_is_refused():
    with pytest.raises(MetricError, match="direction"):

        class Wrong(Metric):
            def score(self, output, target):
                yield "x", 1.0

    class Bare(Metric):
        pass

    with pytest.raises(MetricError, match="direction"):
        Bare()

    with pytest.raises(MetricError, match="direction"):

        class Odd(Metric):
            direction = "up"

    with pytest.raises(MetricError, match="requires"):

        class Needs(Metric):
            direction, required = "maximize", ("other",)


def test_one_call_yields_several_scores(spark):
    class Lengths(Metric):
        direction = {"length": "minimize", "words": "maximize"}
        columns = ("output",)

        def score(self, output):
            if output is not None:
                yield "length", len(output)
                yield "words", float(len(output.split())) if output else None

    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "sample_id int, output string")
    found = Lengths().scores(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "length", 3.0, "minimize", None), (1, "words", 2.0, "maximize", None), (2, "length", 0.0, "minimize", None), (2, "words", None, "maximize", "unknown")]
    assert {r.name: r.n for r in statistics(found, "name").collect()} == {"length": 2, "words": 1}
    with pytest.raises(MetricError, match="no direction"):
        Lengths().direction_of("other")


def test_field_scores_equal_single_ones(spark):
    rows = [(1, '{"a": 1}', '{"a": 1, "b": [2]}'), (2, "x", "{}"), (3, "{}", None), (4, None, "{}")]
    got = {(r.sample_id, r.name): r.value for r in FieldScores().scores(spark.createDataFrame(rows, "sample_id int, output string, target string")).collect()}
    assert got == {(k, n): v for k, a, b in rows if b is not None for n, v in zip(("field_f1", "field_precision", "field_recall"), field_scores(a, b), strict=True)}


def test_names_are_registered_once():
    from verdictframe.plans import registry

    registry.queries()
    with pytest.raises(RegistryError):

        @query()
        def src14_callable_source(spark, sf_dir):
            return None


def test_a_hung_call_is_given_up_and_its_batch_kept(spark):
    from verdictframe.operators.judges import ask

    def make():
        def model(texts):
            if "hang" in texts:
                time.sleep(60)
            if "fail" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return model

    rows = spark.createDataFrame([(t,) for t in ("a", "hang", "b", "fail", "c")], "prompt string").coalesce(1)
    ask(rows.limit(1), make).collect()
    began = time.perf_counter()
    got = {r.prompt: (r.reply, r.error and r.error.split(":")[0]) for r in ask(rows, make, retries=0, timeout=0.3).collect()}
    assert time.perf_counter() - began < 3
    assert got == {"a": ("A", None), "b": ("B", None), "c": ("C", None), "hang": (None, "ModelTimeoutError"), "fail": (None, "RuntimeError")}


def test_time_limits_hold_within_a_second():
    from verdictframe.errors import ModelTimeoutError
    from verdictframe.operators.judges import within

    began = time.perf_counter()
    with pytest.raises(ModelTimeoutError):
        within(0.2, lambda texts: time.sleep(60), ["x"])
    assert time.perf_counter() - began < 1
    assert within(5, lambda texts: texts, ["x"]) == ["x"] and within(None, lambda texts: texts, ["x"]) == ["x"]


def test_a_judge_is_part_of_the_fingerprint():
    from verdictframe.operators.judges import Judge
    from verdictframe.plans import api

    one, two = (Judge("j", t, (("good", 1.0), ("bad", 0.0))) for t in ("Rate {output}", "Judge {output}"))
    model = api.scripted({"a": "CHOICE: good"})
    prints = {api.fingerprint({}, ["exact_match"], judges) for judges in ((), (one.identity(),), (two.identity(),), (one.identity(model),), (one.identity(api.scripted({"a": "CHOICE: bad"})),))}
    assert len(prints) == 5


def test_runs_of_an_experiment_are_compared_by_place_and_by_name(spark):
    from verdictframe.plans import api

    def run(name, right):
        rows = [(str(k), "a", "a" if k < right else "b") for k in range(10)]
        return api.evaluate(spark.createDataFrame(rows, "sample_id string, target string, actual_output string"), ["exact_match"], name=name)

    runs = [run("one", 5), run("two", 9), run("three", 9)]
    experiment = api.Experiment("e")
    for r in runs:
        experiment.add(r)
    assert [(r.place, r.run, r.mean) for r in experiment.leaderboard().orderBy("place").collect()] == [(1, "two", 0.9), (2, "three", 0.9), (3, "one", 0.5)]
    assert experiment.pairwise_diff().first().delta == pytest.approx(0.4) and experiment.pairwise_diff(1, 0).first().grade == "fail"
    assert api.pairwise({r.name: r for r in runs}, "two", "three").first().grade == "pass"
    assert api.compare(runs[1], runs[0], fail=0.5).first().grade == "warn"
    with pytest.raises(KeyError, match="four"):
        api.pairwise({r.name: r for r in runs}, "two", "four")
    with pytest.raises(ValueError):
        api.compare([])


def test_calls_with_equal_arguments_have_one_key(spark):
    from verdictframe.operators.agents import call_key

    rows = [("f", '{"a": 1.0, "b": [1, 2]}'), ("f", '{"b":[1,2],"a":1}'), ("f", '{"a": 1, "b": [2, 1]}'), ("g", ""), ("g", None), ("g", "{}"), ("g", "{"), (None, "{}")]
    keys = [r[0] for r in spark.createDataFrame(rows, "n string, a string").coalesce(1).select(call_key("n", "a")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] == keys[5] == "g:{}" and keys[6:] == [None, None]
