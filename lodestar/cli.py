"""Command line: python -m lodestar.cli COMMAND."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.operators.chunking import chunk_stats
from lodestar.plans.pipeline import PRESETS, Pipeline, Settings, Trace, ablation, compare_chunking
from lodestar.session import release
from lodestar.sources import readers


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestar").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="index a folder of documents")
    p.add_argument("folder")
    p.add_argument("--to", required=True)
    p.add_argument("--strategy", default="recursive")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--tree", action="store_true")
    how.add_argument("--append", action="store_true", help="add the documents to the index in --to")
    p.add_argument("--cache", help="folder of embeddings that are made once")
    for name in ("ask", "chat", "bm25", "evaluate"):
        p = sub.add_parser(name)
        p.add_argument("--index", required=True)
        if name in ("ask", "bm25"):
            p.add_argument("question")
        if name == "ask":
            p.add_argument("--trace", action="store_true", help="show what each stage passed on")
        if name == "evaluate":
            p.add_argument("eval_set")
        p.add_argument("--preset", default="hybrid", choices=sorted(PRESETS))
        p.add_argument("--top-k", type=int, default=None)
    for name in ("compare-chunking", "compare", "demo"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("eval_set")
        p.add_argument("--quick", action="store_true")
    return top


def _one(spark: SparkSession, text: str):
    return spark.createDataFrame([(0, text)], "query_id int, text string")


def _show_answer(rows) -> None:
    for r in rows.collect():
        print(r["final"])
        print("passages:", ", ".join(r["chunk_ids"] or []))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    try:
        return run(spark, args)
    finally:
        release(spark)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = Settings.from_env()
    pipeline = Pipeline.of(settings, PRESETS[getattr(args, "preset", "hybrid")], getattr(args, "cache", None))
    if args.command == "index":
        if args.append:
            store = pipeline.add(readers.read_documents(spark, args.folder), args.to, args.strategy)
            chunk_stats(store.chunks()).show()
            return 0
        index = pipeline.index(readers.read_documents(spark, args.folder), args.strategy, args.tree)
        pipeline.save(index, args.to)
        chunk_stats(spark.read.parquet(f"{args.to}/chunks")).show()
        return 0
    if args.command in ("compare-chunking", "compare", "demo"):
        docs = readers.read_documents(spark, args.folder).cache()
        queries, qrels = readers.read_eval_set(spark, args.eval_set)
        if args.command != "compare":
            compare_chunking(docs, queries, qrels, settings).show(truncate=False)
        if args.command != "compare-chunking":
            ablation(docs, queries, qrels, settings, args.quick).show(truncate=False)
        return 0
    try:
        index = pipeline.load(spark, args.index)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        print("there is no index there: run the index command first", file=sys.stderr)
        return 1
    if args.command == "ask":
        print("techniques:", ", ".join(pipeline.config.active()))
        pipeline.trace = Trace() if args.trace else None
        _show_answer(pipeline.ask(index, _one(spark, args.question), args.top_k))
        if pipeline.trace:
            for stage, n, more in pipeline.trace.rows():
                print(f"{stage}: {n}", *[f"{k} {v}" for k, v in more.items()])
    elif args.command == "chat":
        for line in sys.stdin:
            if line.strip().lower() in ("", "exit", "quit", "sair"):
                break
            _show_answer(pipeline.ask(index, _one(spark, line.strip()), args.top_k))
    elif args.command == "bm25":
        asked = _one(spark, args.question)
        lexical.index_summary(index.lexical).show()
        lexical.explain_terms(index.lexical, asked).orderBy("place").show(50, False)
        lexical.top_k(index.lexical, asked, args.top_k or 10).orderBy("rank").show(truncate=False)
    elif args.command == "evaluate":
        queries, qrels = readers.read_eval_set(spark, args.eval_set)
        pipeline.evaluate(index, queries, qrels, args.top_k).select(
            "n_queries", "k", F.round("hit", 3).alias("hit"), F.round("recall", 3).alias("recall"), F.round("precision", 3).alias("precision"),
            F.round("mrr", 3).alias("mrr"), F.round("ndcg", 3).alias("ndcg"),
        ).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
