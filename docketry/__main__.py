"""Command line: process, loadfile, classify, index, search, stats, export, remove, enrich.

Converters, embedders, rerankers and models are functions of yours, named as module:function.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketry import app, config
from docketry.operators import classify, retrieve
from docketry.sources import files


def function(name: str | None):
    """The function that 'module:function' names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docketry", description=__doc__)
    shared = argparse.ArgumentParser(add_help=False)
    # given before or after the command; the one after it counts
    shared.add_argument("--config", default=argparse.SUPPRESS, help="settings, JSON or YAML")
    shared.add_argument("--verbose", action="store_true", default=argparse.SUPPRESS)
    top.add_argument("--config", help="settings, JSON or YAML")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process", parents=[shared], help="convert, cite and chunk the files below a folder, and index them")
    p.add_argument("input")
    p.add_argument("corpus")
    for name in ("--converter", "--embed", "--model"):
        p.add_argument(name, help="module:function")
    p.add_argument("--labels", help="table of types that a person has given (stem, doc_type)")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-skip-failed", dest="skip_failed", action="store_false")
    p.add_argument("--no-index", dest="index", action="store_false")
    p.add_argument("--no-loadfile", dest="loadfile", action="store_false")
    p = commands.add_parser("loadfile", parents=[shared], help="take up productions with load files")
    p.add_argument("input")
    p.add_argument("corpus")
    p.add_argument("--recognise", help="module:function that reads a page image")
    p.add_argument("--no-paginate", dest="paginate", action="store_false")
    p.add_argument("--no-index", dest="index", action="store_false")
    p = commands.add_parser("classify", parents=[shared], help="types of the files below a folder, by name and text")
    p.add_argument("input")
    p.add_argument("--profiles", help="table of learned profiles")
    p = commands.add_parser("index", parents=[shared], help="bring the indexes up to date")
    p.add_argument("corpus")
    p.add_argument("--embed", help="module:function")
    p.add_argument("--force-rebuild", dest="force", action="store_true")
    p = commands.add_parser("search", parents=[shared], help="search the indexed chunks")
    p.add_argument("corpus")
    p.add_argument("query")
    p.add_argument("--top-k", type=int)
    p.add_argument("--mode", choices=retrieve.MODES)
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--embed-query", help="module:function")
    p = commands.add_parser("stats", parents=[shared], help="chunks by document, and which indexes there are")
    p.add_argument("corpus")
    p = commands.add_parser("export", parents=[shared], help="write the tables as JSON files")
    p.add_argument("corpus")
    p.add_argument("output")
    p = commands.add_parser("remove", parents=[shared], help="take a document out of tables and indexes")
    p.add_argument("corpus")
    p.add_argument("name")
    p = commands.add_parser("enrich", parents=[shared], help="ask a model about chunks")
    p.add_argument("corpus")
    p.add_argument("--model", required=True, help="module:function")
    p.add_argument("--backend", default="model")
    p.add_argument("--case-type")
    p.add_argument("--parties", default="")
    p.add_argument("--force", action="store_true")
    return top


def show(df) -> None:
    for row in app.as_json(df).toLocalIterator():
        print(row.value)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    given = {"search": {"top_k": getattr(args, "top_k", None), "mode": getattr(args, "mode", None)}, "enrichment": {"case_type": getattr(args, "case_type", None)}}
    settings = config.settings(args.config, given)
    if args.command == "classify":
        found = files.discover(spark, args.input)
        rows = files.by_stem(found).select("stem", F.col("name").alias("file_name"), F.when(F.col("ext") == "txt", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.lit(1).alias("n_pages"))
        learned = spark.read.parquet(args.profiles) if args.profiles else None
        show(classify.classify(rows, learned=learned, key="stem").orderBy("stem"))
        return 0
    corpus = app.Corpus(spark, args.corpus, settings)
    if args.command == "process" and args.loadfile and loadfiles(spark, args.input):
        args.command, args.recognise, args.paginate = "loadfile", None, True
    if args.command == "process":
        began = time.time()
        labels = spark.read.parquet(args.labels) if args.labels else None
        results = corpus.process(args.input, function(args.converter), labels, args.force, args.skip_failed)
        for row in corpus.report(time.time() - began).toLocalIterator():
            print(f"{row.title:28} {row.line}")
        if args.model:
            print(app.plain(corpus.enrich(function(args.model), args.model)))
        if args.index and results.filter("status = 'OK'").take(1):
            print(app.plain(corpus.index(function(args.embed))))
        return 1 if results.filter("status = 'FAILED'").take(1) else 0
    if args.command == "loadfile":
        show(corpus.ingest(args.input, natives={}, recognise=function(args.recognise), pagination=args.paginate and settings["pagination"]["enabled"]))
        if args.index:
            print(app.plain(corpus.index()))
    elif args.command == "index":
        print(app.plain(corpus.index(function(args.embed), args.force)))
    elif args.command == "search":
        show(corpus.search(args.query, settings["search"]["top_k"], settings["search"]["mode"], args.rerank, function(args.embed_query), retrieve.shared_words))
    elif args.command == "stats":
        by, totals = corpus.stats()
        print(app.plain(totals))
        show(by)
    elif args.command == "export":
        corpus.export(args.output)
    elif args.command == "remove":
        print(app.plain(corpus.remove(args.name)))
    else:
        from docketry.operators import enrich

        context = enrich.context_lines(settings["enrichment"]["case_type"], [x.strip() for x in args.parties.split(",") if x.strip()])
        print(app.plain(corpus.enrich(function(args.model), args.backend, context, args.force)))
    return 0


def loadfiles(spark: SparkSession, root: str) -> bool:
    """Whether there is a load file below root."""
    try:
        return bool(files.discover(spark, root, extensions=("dat",), content=False).take(1))
    except FileNotFoundError:
        return False


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("docketry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("WARN" if args.verbose else "ERROR")
    try:
        return run(args, spark)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
