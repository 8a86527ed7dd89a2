"""Command line: evaluate a dataset with recorded outputs, compare two, or list what there is.

python -m verdictframe evaluate PATH [--scorers A,B] [--limit N] [--save FOLDER]
python -m verdictframe compare BASELINE CANDIDATE [--scorers A,B]
python -m verdictframe list
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from verdictframe.functions.scorers import SCORERS
from verdictframe.plans import api
from verdictframe.sources.datasets import read_dataset


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verdictframe", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate")
    one.add_argument("path")
    one.add_argument("--limit", type=int)
    one.add_argument("--save")
    two = commands.add_parser("compare")
    two.add_argument("baseline")
    two.add_argument("candidate")
    for p in (one, two):
        p.add_argument("--scorers", type=lambda s: s.split(","))
    commands.add_parser("list")
    args = parser.parse_args(arguments)
    if args.command == "list":
        for s in SCORERS.values():
            print(f"{s.name}\t{s.direction}\t{', '.join(s.arguments)}")
        return 0
    spark = SparkSession.builder.appName("verdictframe").getOrCreate()
    if args.command == "evaluate":
        run = api.evaluate(read_dataset(spark, args.path), args.scorers, limit=args.limit)
        run.statistics().orderBy("name").show(truncate=False)
        if args.save:
            run.save(args.save)
        return 0
    runs = [api.evaluate(read_dataset(spark, p), args.scorers, name=p) for p in (args.baseline, args.candidate)]
    graded = api.compare(*runs).orderBy("name")
    graded.show(truncate=False)
    return int(graded.where("grade = 'fail'").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
