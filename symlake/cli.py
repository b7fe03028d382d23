"""Command line: index, search, explain, find-usage, related, impact, window, evaluate, localise, benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import evaluation
from .config import Settings
from .indexing import index_tree
from .search import Index
from .sources.trees import yaml_cases


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symlake")
    p.add_argument("--config")
    p.add_argument("--index-path")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("root")
    for flag in ("--llm-provider", "--llm-model", "--llm-base-url", "--llm-api-key", "--embedding-provider", "--embedding-model"):
        c.add_argument(flag)
    c.add_argument("--llm-temperature", type=float)
    for flag in ("--llm-max-tokens", "--embedding-batch-size"):
        c.add_argument(flag, type=int)
    c.add_argument("--enable-llm", action="store_const", const=True)
    c.add_argument("--embedding-dimensions", type=int)
    c.add_argument("--no-vectors", action="store_const", const=False, dest="vectors")
    c.add_argument("--on-error", choices=("fail", "skip"))
    for name in ("search", "explain", "find-usage", "related", "impact"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--root")
        c.add_argument("--limit", type=int, default=10)
        if name == "search":
            c.add_argument("--no-vectors", action="store_true")
        if name == "impact":
            c.add_argument("--depth", type=int, default=2)
            c.add_argument("--radius", type=int, default=12)
    c = sub.add_parser("window")
    c.add_argument("root")
    c.add_argument("path")
    c.add_argument("line", type=int)
    c.add_argument("--radius", type=int, default=20)
    for name in ("evaluate", "localise", "benchmark"):
        c = sub.add_parser(name)
        c.add_argument("root", help="the tree; for benchmark a folder with a tree for each bug, under its name")
        c.add_argument("--cases", required=True)
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--reuse-index", action="store_true")
        if name != "evaluate":
            c.add_argument("--with-vectors", action="store_true")
        if name == "benchmark":
            c.add_argument("--output")
        if name == "localise":
            c.add_argument("--radius", type=int, default=12)
    return p


def _measured(args: argparse.Namespace, spark: SparkSession, settings: Settings) -> dict:
    """Reports of the three commands that measure."""
    vectors = getattr(args, "with_vectors", False)
    cases = yaml_cases(spark, args.cases, evaluation.CASES if args.command == "evaluate" else evaluation.BUG_CASES)
    if args.command == "benchmark":
        bugs = [r.bug_id for r in cases.select("bug_id").distinct().orderBy("bug_id").collect()]
        out = evaluation.benchmark_report(spark, cases, {b: os.path.join(args.root, b) for b in bugs}, settings, args.limit, vectors, args.reuse_index)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                json.dump(out, f, indent=2, default=str)
        return out
    settings = settings.with_overrides(vectors=vectors)
    if not args.reuse_index:
        index_tree(spark, args.root, settings)
    index = Index(spark, settings, args.root)
    if args.command == "evaluate":
        metrics, summary = evaluation.evaluate(index, cases, args.limit)
        return {"cases": [r.asDict() for r in metrics.orderBy("mode", "id").collect()], "summary": [r.asDict() for r in summary.collect()]}
    if vectors:
        index.check_vectors()
    found = evaluation.case_reports(index, cases, args.limit, radius=args.radius, vectors=vectors)
    return {"root": args.root, "cases_path": args.cases, "summary": evaluation.means([c["metrics"] for c in found]), "cases": found}


def run(args: argparse.Namespace, spark: SparkSession):
    settings = Settings.from_yaml(args.config) if args.config else Settings()
    settings = settings.with_overrides(index_path=args.index_path)
    if args.command == "index":
        settings = settings.with_overrides(**{"llm.provider": args.llm_provider, "llm.model": args.llm_model, "llm.base_url": args.llm_base_url, "llm.api_key": args.llm_api_key, "llm.temperature": args.llm_temperature, "llm.max_tokens": args.llm_max_tokens, "llm.enabled": args.enable_llm, "embeddings.provider": args.embedding_provider, "embeddings.model": args.embedding_model, "embeddings.dimensions": args.embedding_dimensions, "embeddings.batch_size": args.embedding_batch_size, "vectors": args.vectors, "on_error": args.on_error})
        return index_tree(spark, args.root, settings)
    if args.command in ("evaluate", "localise", "benchmark"):
        return _measured(args, spark, settings)
    index = Index(spark, settings, args.root)
    match args.command:
        case "search":
            return index.search_or_graph(args.query, args.limit, not args.no_vectors)
        case "explain":
            return index.explain(args.query)
        case "find-usage":
            return index.usages(args.query)
        case "related":
            return index.related(args.query, args.limit)
        case "impact":
            return index.impact(args.query, args.depth, args.limit, args.radius)
        case "window":
            return index.window(args.path, args.line, args.radius)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("symlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(args, spark), indent=2, default=str))
    except RuntimeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
