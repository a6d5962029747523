"""Jobs from a command line: ``python -m hopweave.cli run QUERY... --data DIR --out DIR`` writes the results of queries,
``list`` names them, and ``score`` compares answers (query_id, gold, predicted) with their gold."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hopweave")
    sub = parser.add_subparsers(dest="job", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("queries", nargs="+")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    score = sub.add_parser("score")
    score.add_argument("answers")
    args = parser.parse_args(argv)
    import hopweave.plans.eval_queries  # noqa: F401  these fill the registry
    import hopweave.plans.graph_queries  # noqa: F401
    import hopweave.plans.lifecycle_queries  # noqa: F401
    import hopweave.plans.model_queries  # noqa: F401
    import hopweave.plans.retrieval_queries  # noqa: F401
    import hopweave.plans.text_queries  # noqa: F401
    from hopweave.operators.evaluation import exact_match, token_f1
    from hopweave.plans.registry import QUERIES

    if args.job == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("hopweave").getOrCreate()
    if args.job == "score":
        answers = spark.read.json(args.answers)
        means = exact_match(answers).join(token_f1(answers), "query_id").selectExpr("count(1) AS n", "round(avg(em), 4) AS em", "round(avg(f1), 4) AS f1").first()
        print(json.dumps(means.asDict()))
        return 0
    unknown = [q for q in args.queries if q not in QUERIES]
    if unknown:
        print(f"unknown: {', '.join(unknown)}", file=sys.stderr)
        return 2
    for name in args.queries:
        QUERIES[name](spark, args.data).write.mode("errorifexists").parquet(f"{args.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
