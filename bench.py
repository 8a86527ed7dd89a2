"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is written to the noop sink, so all its rows and columns are computed; the time is the median of two runs
behind a warm one. Further queries are timed once warm (more), and small computations against their upper limits (bounds).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from verdictframe.plans import registry  # noqa: E402

HEADLINE = [
    "agg01_run_stats",
    "agg13_per_task",
    "agg02_percentiles",
    "agg03_latency_stats",
    "agg16_reliability",
    "txt10_levenshtein",
    "txt13_f1_score",
    "txt18_token_overlap",
    "txt19_bm25_similarity",
    "txt31_representation_skew",
    "txt14_bleu",
    "txt16_chrf",
    "ret01_retrieval",
    "join02_sample_diff",
    "join08_evidence_recall",
    "join09_freshness",
    "join10_citation_support",
    "cmp01_paired_bootstrap",
    "cmp01_poisson_bootstrap",
    "cmp06_comparison_table",
    "agg22_agreement",
    "agt01_tool_call_f1",
    "agt02_trajectory_match",
    "agt06_loops",
    "sec01_redact",
]


MORE = ["src15_import_mixed", "udf02_several_scores", "flt03_stratified_split", "txt15_rouge_l_documents"]


def bounds() -> dict[str, dict[str, float]]:
    """Seconds of single computations and the limits that they must hold."""
    from verdictframe.functions import matching as M  # noqa: N812
    from verdictframe.functions.bitparallel import common_subsequence, edit_distance
    from verdictframe.functions.calls import parse_calls

    groups = [[f"a{i}", f"b{i}"] for i in range(2000)]
    long = [[str(i * k % 5000) for i in range(20_000)] for k in (7, 11)]
    tried = {
        "parallel_2000_groups": (5, lambda: M.parallel_scores(groups, groups)),
        "matching_2000_x_2000": (10, lambda: M.maximum_matching(["x"] * 2000, ["x"] * 2000, lambda a, b: a == b)),
        "in_order_20000_calls": (1, lambda: M.in_order([[f"c{i}"] for i in range(20_000)], [["c0"], ["c19999"]])),
        "parse_20000_unclosed_tags": (1, lambda: parse_calls("<tool_call>" * 20_000)),
        "rouge_l_20000_words": (5, lambda: common_subsequence(*long)),
        "word_error_rate_20000_words": (5, lambda: edit_distance(*long)),
    }
    out = {}
    for name, (limit, compute) in tried.items():
        began = time.perf_counter()
        compute()
        out[name] = {"sec": round(time.perf_counter() - began, 3), "limit": limit}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()

    def timed(name: str, runs: int) -> float:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return round(median(took[1:]), 3)

    seconds, more = {name: timed(name, 2) for name in HEADLINE}, {name: timed(name, 1) for name in MORE}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name, "more": more, "bounds": bounds()}))
    spark.stop()


if __name__ == "__main__":
    main()
