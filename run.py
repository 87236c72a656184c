"""Command line: run the pipeline, promote a model, score ids, show reports, index texts, ask."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from creditloom.operators import decisions, model, registry
from creditloom.plans import pipeline, policy_index, serving
from creditloom.session import configure, stages_of_run, write_stage
from creditloom.sources import landing
from creditloom.sources.snapshots import known_table, update_part

PROFILES = {"versioned": model.VERSIONED, "full": model.FULL}


def run_pipeline(spark: SparkSession, args: argparse.Namespace) -> str:
    result = pipeline.run_pipeline(
        spark,
        args.raw,
        args.lake,
        args.run_id or f"run-{dt.datetime.now():%Y%m%d%H%M%S}",
        args.date,
        as_of=args.as_of,
        version=args.version,
        profile=PROFILES[args.profile],
        promote=args.promote,
    )
    return f"{result.version} {result.status} {result.metrics} {result.seconds}"


def promote(spark: SparkSession, args: argparse.Namespace) -> str:
    path = pipeline.LakePaths(args.lake).model_registry
    known_table(spark, path)  # must be there
    update_part(spark, path, lambda table: registry.promote(table, args.version))
    return f"{args.version} is active"


def score(spark: SparkSession, args: argparse.Namespace) -> str:
    with stages_of_run(spark):
        decided = write_stage(serving.decisions(spark, args.lake), "decisions")
        ids = landing.read_ids(spark, args.ids, args.limit)
        landing.write_csv(decisions.score_ids(ids, decided), args.out)
    return f"written to {args.out}"


def show(spark: SparkSession, args: argparse.Namespace) -> str:
    """Print or write one report over the lake."""
    with stages_of_run(spark):
        report = serving.REPORTS[args.report](spark, args.lake, *args.key)
        if args.out:
            landing.write_csv(report, args.out)
            return f"written to {args.out}"
        report.show(args.rows, truncate=False)
    return ""


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    """The prompt of a question: nearest passages, the application if one is named, question."""
    with stages_of_run(spark):
        return serving.prompt(spark, args.lake, args.question, args.application).first()["prompt"]


def index(spark: SparkSession, args: argparse.Namespace) -> str:
    with stages_of_run(spark):
        n = policy_index.build_index(spark, args.docs, f"{args.lake}/policy_index", args.reset)
    return f"{n} chunks"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(required=True)

    p = sub.add_parser("pipeline")
    p.add_argument("--raw", required=True)
    p.add_argument("--lake", required=True)
    p.add_argument("--date", type=dt.date.fromisoformat, default=dt.date.today())
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    p.add_argument("--run-id", default=None)
    p.add_argument("--version", default=None)
    p.add_argument("--profile", choices=PROFILES, default="versioned")
    p.add_argument("--promote", action="store_true")
    p.set_defaults(step=run_pipeline)

    p = sub.add_parser("promote")
    p.add_argument("--lake", required=True)
    p.add_argument("--version", required=True)
    p.set_defaults(step=promote)

    p = sub.add_parser("score")
    p.add_argument("--lake", required=True)
    p.add_argument("--ids", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--limit", type=int, default=None, help="so many rows; all if not given")
    p.set_defaults(step=score)

    p = sub.add_parser("show")
    p.add_argument("report", choices=serving.REPORTS)
    p.add_argument("key", nargs="*", help="customer; application and model version")
    p.add_argument("--lake", required=True)
    p.add_argument("--out", default=None)
    p.add_argument("--rows", type=int, default=60, help="rows to print")
    p.set_defaults(step=show)

    p = sub.add_parser("ask")
    p.add_argument("question")
    p.add_argument("--lake", required=True)
    p.add_argument("--application", default=None)
    p.set_defaults(step=ask)

    p = sub.add_parser("index")
    p.add_argument("--lake", required=True)
    p.add_argument("--docs", required=True)
    p.add_argument("--reset", action="store_true")
    p.set_defaults(step=index)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName("creditloom").getOrCreate())
    print(args.step(spark, args))


if __name__ == "__main__":
    main()
