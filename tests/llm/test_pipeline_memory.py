"""The pipeline over whole texts in a small heap: what a task reads and writes at a time is bounded."""

import corpus_pipeline
from verdictframe.llm import cluster


def test_texts_are_read_in_small_batches(spark, sf):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    set_before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        corpus_pipeline.rules(spark, cluster.read(spark, sf, "documents"), sf)
        assert int(spark.conf.get(key)) == cluster.READ_ROWS < 4096
        spark.conf.set(key, "1000")  # a setting of the user's stays
        corpus_pipeline.rules(spark, cluster.read(spark, sf, "documents"), sf)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, set_before)


def test_stages_write_small_row_groups(spark, sf, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    groups = []
    keep = lambda spark, docs, sf_dir: docs.coalesce(1)

    def look(spark, docs, sf_dir):
        groups.extend(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in docs.inputFiles())
        return docs

    monkeypatch.setattr(corpus_pipeline, "ROW_GROUP_BYTES", 1 << 15)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", keep), ("last", look)])
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert groups and max(groups) > 1
