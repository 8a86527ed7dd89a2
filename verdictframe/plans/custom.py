"""Sources and metrics of one's own over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import text as T
from verdictframe.functions.metrics import FieldScores
from verdictframe.operators import comparison as C
from verdictframe.plans import api
from verdictframe.plans.registry import query, table
from verdictframe.sources.callables import from_callable


def _file_rows(part):
    """Every n-th row group's rows of a Parquet file; a file with fewer row groups is dealt by slices."""
    import pyarrow.fs
    import pyarrow.parquet

    uri, k, n = part
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        file = pyarrow.parquet.ParquetFile(f)
        for g in range(file.num_row_groups):
            rows = file.read_row_group(g, columns=["doc_id", "lang", "n_chars"])
            mine = range(k, rows.num_rows, n) if file.num_row_groups < n else range(rows.num_rows) if g % n == k else range(0)
            if len(mine):
                yield from rows.take(list(mine)).to_batches()


@query("SELECT doc_id, lang, n_chars FROM documents")
def src14_callable_source(spark, sf_dir):
    """The documents, read by a plain function: in four tasks a file, each time the table is read."""
    files = sorted(table(spark, sf_dir, "documents").inputFiles())
    return from_callable(spark, _file_rows, [(f, k, 4) for f in files for k in range(4)], "doc_id long, lang string, n_chars long")


_FIELDS = "(VALUES ('field_f1'), ('field_precision'), ('field_recall')) t(name)"


@query(
    f"SELECT o_orderkey AS sample_id, name, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.5 END AS value, 'maximize' AS direction FROM orders, {_FIELDS} WHERE o_orderkey % 3 > 0"
    f" UNION ALL SELECT o_orderkey, name, 0.0::DOUBLE, 'maximize' FROM orders, {_FIELDS} WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"
)
def udf02_several_scores(spark, sf_dir):
    """Three scores from one call a sample; outputs that are no JSON score 0, samples without a target aren't scored."""
    made = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")))
    wanted = F.to_json(F.struct(F.col("o_custkey").cast("double").alias("c"), F.lit("O").alias("s")))
    third, even = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(third, F.lit("no JSON")).otherwise(made).alias("output"), F.when(~third | even, wanted).alias("target"))
    return FieldScores().scores(samples).drop("status")


@query(
    "WITH m AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT 'task' || substr(p, 1, 1) || ':' || substr(p, 3) AS name, CASE WHEN p < '3' THEN 'minimize' ELSE 'maximize' END AS direction FROM m"
)
def cmp03_directions(spark, sf_dir):
    """Directions of metrics named by task: the metric's own, else that of its base, else to maximise."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("task"), F.substring("o_orderpriority", 3, 100).alias("base")).distinct()
    said = o.where("task < '3'").select(F.col("base").alias("name"), F.lit("minimize").alias("direction"), "o_orderkey")
    names = o.select(F.concat(F.lit("task"), "task", F.lit(":"), "base").alias("name")).distinct()
    return C.with_direction(names, C.first_directions(said, "o_orderkey"))


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("F").alias("target"), F.col("o_orderstatus").alias("actual_output"), "o_orderpriority")
    return [api.evaluate(o.where(F.col("o_orderpriority").startswith(str(k))), ["exact_match"], name=f"run{k}") for k in range(1, 6)]


@query(
    "WITH m AS (SELECT substr(o_orderpriority, 1, 1) AS k, avg((o_orderstatus = 'F')::INT) AS mean, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT CAST(row_number() OVER (ORDER BY mean DESC, k) AS INTEGER) AS place, 'run' || k AS run, round(mean, 9) AS mean, n FROM m"
)
def api04_leaderboard(spark, sf_dir):
    """Several runs compared: a leaderboard by their first metric."""
    return api.compare(_runs(spark, sf_dir)).select("place", "run", T.rounded("mean", 9).alias("mean"), "n")


@query(
    "WITH m AS (SELECT substr(o_orderpriority, 1, 1) AS k, avg((o_orderstatus = 'F')::INT) AS mean FROM orders GROUP BY 1), d AS (SELECT (SELECT mean FROM m WHERE k = '5') - (SELECT mean FROM m WHERE k = '1') AS delta)"
    " SELECT 'exact_match' AS name, round(delta, 9) AS delta, CASE WHEN -delta >= 0.05 THEN 'fail' WHEN -delta >= 0.02 THEN 'warn' ELSE 'pass' END AS grade FROM d"
)
def cmp11_pairwise_diff(spark, sf_dir):
    """The last run of an experiment against its first."""
    return api.Experiment("orders", _runs(spark, sf_dir)).pairwise_diff().select("name", T.rounded("delta", 9).alias("delta"), "grade")
