"""Queries over their whole tables, and steps whose rows and memory must not grow faster than the input."""

from pyspark.sql import functions as F

from verdictframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_answer_letters_of_every_order(spark, sf):
    found = QUERIES["src12_answer_letters"](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert found.count() == orders.count()
    assert {r.target for r in found.select("target").distinct().collect()} == set(range(5))


def test_draws_of_a_block_in_parts_pick_the_same_values(monkeypatch):
    import numpy as np

    from verdictframe.operators import comparison

    values, draws = np.random.default_rng(1).normal(size=1001), np.random.default_rng(2).binomial(4000, 0.25, 300)
    draws[5:9] = 0
    whole = comparison.block_sums(values, draws, 1, 2)
    monkeypatch.setattr(comparison, "DRAWS_AT_ONCE", 5000)
    asked, make = [], np.random.default_rng

    class Stream:
        def __init__(self, seed):
            self.stream = make(seed)

        def integers(self, low, high, size):
            asked.append(size)
            return self.stream.integers(low, high, size)

    monkeypatch.setattr(np.random, "default_rng", Stream)
    np.testing.assert_allclose(comparison.block_sums(values, draws, 1, 2), whole, atol=1e-9)
    assert sum(asked) == draws.sum() and max(asked) <= 5000 + draws.max()


def test_texts_are_sketched_in_small_chunks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from verdictframe.llm import near_dedup

    held, sketch = [], near_dedup.superminhash
    monkeypatch.setattr(near_dedup, "superminhash", lambda values, counts: held.append(len(values)) or sketch(values, counts))
    texts = pa.array([" ".join(f"w{i * j % 997}" for j in range(300)) for i in range(1, 800)])
    ids = pa.array(np.arange(len(texts)))
    (out,) = near_dedup._sketches(iter([pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])]))
    assert out.num_rows == len(texts) and max(held) * near_dedup.SLOTS <= 16 << 20


def test_numbers_of_groups_as_pair_by_pair(spark):
    from verdictframe.operators import rag

    gold = spark.createDataFrame([(i, i % 3, f"no {i % 7}, 1,0{i % 2}0") for i in range(60)] + [(99, 0, "none")], "case_id long, group int, text string")
    replies = spark.createDataFrame([(i % 3, f"{i % 7} and {1000 + 10 * (i % 2)}") for i in range(40)], "group int, text string")
    got = rag.numeric_accuracy_of_groups(gold, replies, 5)
    want = gold.withColumnRenamed("text", "a").join(replies, "group").select("case_id", rag.numeric_accuracy(F.col("a"), F.col("text")))
    assert sorted(map(str, got.collect())) == sorted(str(r).replace(r.__fields__[1], "numeric_accuracy") for r in want.collect())


def test_scores_by_label_as_from_all_relevant_pairs(spark):
    from verdictframe.operators import retrieval

    items = spark.createDataFrame([(i, i * i % 5) for i in range(60)] + [(60, 9)], "item long, label int")
    queries = items.where("item % 10 = 0").select(F.col("item").alias("query_id"), "label")
    ranked = spark.createDataFrame([(q, q * 7 % 61 + k if q * 7 % 61 + k < 61 else k, k + 1) for q in range(0, 61, 10) for k in range(8)], "query_id long, item long, rank long").where("query_id <> item")
    every = queries.join(items, "label").where("query_id <> item").select("query_id", "item", F.lit(1.0).alias("grade"))
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert plain(retrieval.retrieval_scores_by_label(ranked, items, queries, 5)) == plain(retrieval.retrieval_scores(ranked, every, 5))


def test_slow_scorers_get_their_rows_in_many_tasks(spark, sf):
    from verdictframe.plans import text

    for rows in (text.NAMES, text.QA):
        assert text.scored_rows(spark, sf, rows).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 20) + "b"


def test_distances_side_by_side_equal_those_one_by_one(monkeypatch):
    import random

    from verdictframe.functions import bitparallel

    rng, pairs = random.Random(5), []
    for _ in range(250):
        letters = rng.choice(["ab", "abcdefgh ", "aé漢😀 x"])
        pairs.append(tuple("".join(rng.choices(letters, k=rng.choice([0, 1, 63, 64, 65, 128, rng.randrange(400)]))) for _ in range(2)))
    pairs += [("same", "same"), ("", ""), ("a" * 200, "a" * 130), ("x" * 70, "y" * 700)]
    want = [bitparallel.edit_distance(a, b) for a, b in pairs]
    one_by_one = bitparallel.edit_distance
    monkeypatch.setattr(bitparallel, "STEP_COST", 0.0)
    monkeypatch.setattr(bitparallel, "LANE_COST", 0.0)
    monkeypatch.setattr(bitparallel, "edit_distance", lambda a, b: 1 / 0)
    assert bitparallel.edit_distances(pairs) == want
    monkeypatch.setattr(bitparallel, "LANES", 7)
    assert bitparallel.edit_distances(pairs) == want
    monkeypatch.setattr(bitparallel, "edit_distance", one_by_one)
    monkeypatch.setattr(bitparallel, "MASKS", 60)  # too many symbols for most
    assert bitparallel.edit_distances(pairs) == want


def test_long_texts_are_scored_many_at_a_time(spark, sf, monkeypatch):
    from verdictframe.functions import bitparallel, vectorised

    alone = []
    one_by_one = bitparallel.edit_distance
    monkeypatch.setattr(bitparallel, "edit_distance", lambda a, b: alone.append(1) or one_by_one(a, b))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    pairs = list(zip(texts, texts[1:]))
    got = vectorised.character_accuracies(pairs)
    assert got == [vectorised.character_accuracy_score(a, b) for a, b in pairs]
    assert len(alone) - len(pairs) < len(pairs) / 2
    monkeypatch.undo()
    rows = spark.createDataFrame([*pairs, (None, "x"), ("", None)], "output string, target string").repartition(3)
    assert sorted(r[0] for r in rows.select(vectorised.character_accuracy("output", "target")).collect()) == sorted([*got, 0.0, 0.0])


def test_numbers_of_groups_look_only_at_pairs_that_share_one(spark, monkeypatch):
    from verdictframe.operators import rag

    texts = ["", None, "none", "0", "-0", "0.0 and 7", "7", "7, 7 and 8", "8 or 7", "1,000", "1000 8 7", "9"]
    gold = spark.createDataFrame([(i, i % 3 if i % 10 else None, texts[i % len(texts)]) for i in range(150)], "case_id long, group int, text string")
    replies = spark.createDataFrame([(i % 2 if i % 9 else None, texts[i * 5 % len(texts)]) for i in range(130)], "group int, text string")
    want = gold.withColumnRenamed("text", "a").join(replies, "group").select("case_id", rag.numeric_accuracy(F.col("a"), F.col("text")).alias("v"))
    got = rag.numeric_accuracy_of_groups(gold, replies, 3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(want, held):
        calls.add(1)
        return float(set(want) <= set(held))

    monkeypatch.setattr(rag, "numbers_held", counted)
    many = spark.range(200).selectExpr("id as case_id", "id % 2 as group", "concat('n ', id) as text")
    assert rag.numeric_accuracy_of_groups(many, many.select("group", "text")).groupBy("numeric_accuracy").count().collect() is not None
    assert 0 < calls.value < 1000
