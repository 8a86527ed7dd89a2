"""Scores to six places, and shares of texts without words, as the SQL has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_halves_round_as_in_sql(spark):
    pairs = [(k, n) for n in (64, 640, 1280, 3200) for k in range(-n, n + 1)] + [(None, 1)]
    got = spark.createDataFrame(pairs, "k long, n long").select("k", "n", T.rounded(F.col("k") / F.col("n")).alias("v")).collect()
    c = duckdb.connect()
    c.execute("create table p (k bigint, n bigint, v double)")
    c.executemany("insert into p values (?, ?, ?)", [tuple(r) for r in got])
    assert c.sql("select k, n, v, round(k / n::DOUBLE, 6) from p where v is distinct from round(k / n::DOUBLE, 6)").fetchall() == []
    assert {(r.k, r.n): r.v for r in got}[41, 640] == 0.064062


@pytest.mark.parametrize("name", ["txt18_token_overlap", "txt27_context_coverage", "txt29_answer_overlap"])
def test_shares_of_texts_as_in_sql(name, spark, tmp_path):
    words = [f"w{k}" for k in range(640)]
    texts = [" ".join(words[:41]), " ".join(words), " ".join(words[:323]), " ".join(words), "### ... !", "some w1 text", None, "more text", "", "w1"]
    if name.startswith("txt18"):
        texts = texts[:4]
    rows = [(k, text, "en", "s", 0) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.sample_id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == dict(c.sql(f"select sample_id, score from ({SQL[name]})").fetchall())
    assert got[0] == 0.064062
