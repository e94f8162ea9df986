"""python -m gleaner index | search | batch | crawl | train | predict | report | serve"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import api
from gleaner.operators import crawl, html, index, ml, report, search
from gleaner.sources import readers, sinks, web


INDEX = (("-i", "--index"), {"required": True})
COMMANDS = {
    "index": ((("--pages",), {"required": True, "help": "a Parquet table (url, html) or a folder of HTML files"}), (("-o", "--output"), {"required": True})),
    "search": (INDEX, (("-q", "--query"), {"required": True}), (("-t", "--top-n"), {"default": 10, "type": int}), (("-c", "--context-size"), {"default": 20, "type": int})),
    "batch": (INDEX, (("-b", "--batch"), {"required": True}), (("-o", "--output"), {"required": True}), (("-t", "--top-n"), {"default": 100, "type": int})),
    "crawl": (
        (("--seeds",), {"required": True, "help": "a TOML file of [[sites]]"}),
        (("-o", "--output"), {"required": True, "help": "folder of the state, which is gone on with"}),
        (("--page-model",), {"help": "a model that train page wrote"}),
        (("--link-model",), {}),
        (("--accept-all",), {"action": "store_true", "help": "score every page and link 1 where a model is missing"}),
        (("--rounds",), {"type": int}),
        (("--pause",), {"type": float, "default": 1.0, "help": "seconds between two pages of a host"}),
    ),
    "train": (
        (("kind",), {"choices": ("page", "link")}),
        (("--labels",), {"required": True, "help": "an export of ratings: .jsonl or Parquet"}),
        (("-o", "--output"), {"required": True, "help": "folder for model.json, metrics.json and validation.jsonl"}),
        (("--iterations",), {"type": int}),
    ),
    "predict": ((("kind",), {"choices": ("page", "link")}), (("--model",), {"required": True}), (("--rows",), {"required": True}), (("-o", "--output"), {"required": True})),
    "report": ((("--crawl",), {"required": True, "help": "folder of a written crawl state"}), (("--json",), {"action": "store_true"})),
    "serve": (INDEX, (("--labels",), {}), (("--port",), {"default": 8000, "type": int})),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        command = sub.add_parser(name)
        for flags, how in options:
            command.add_argument(*flags, **how)
    return p


def build(spark: SparkSession, pages: str, output: str) -> None:
    files = pages.rstrip("/").endswith(".parquet")
    source = spark.read.parquet(pages) if files else readers.html_files(spark, pages).withColumnRenamed("path", "url")
    docs = index.documents(html.parse_pages(source, fields=("main_text",)), "url", "main_text")
    index.build(docs, output)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return readers.json_lines(spark, path) if path.rstrip("/").endswith(".jsonl") else spark.read.parquet(path)


def crawl_sites(spark: SparkSession, a: argparse.Namespace) -> None:
    found = readers.seeds(spark, a.seeds)
    if found.isEmpty():
        raise SystemExit(f"{a.seeds} holds no usable seeds")
    critics = []
    for name, make in (("page_model", ml.page_critic), ("link_model", ml.link_critic)):
        path = getattr(a, name)
        if not path and not a.accept_all:
            raise SystemExit(f"--{name.replace('_', '-')} is needed, or --accept-all")
        try:
            critics.append(make(ml.Classifier.load(path)) if path else lambda: F.lit(1.0))
        except FileNotFoundError as e:
            raise SystemExit(str(e)) from e
    first = found.agg(F.max("request_timeout"), F.max("retry_delay"), F.max("request_delay"), F.max("retries")).first()
    get = web.fetcher(spark.sparkContext.defaultParallelism, max(a.pause, 0.0), timeout=first[0], delay=first[1], retries=first[3])
    done = crawl.crawl(found, get, *critics, crawl.Settings(rounds=a.rounds), folder=a.output)
    for r in done.statistics.orderBy("seed").collect():
        print(f"{r['seed']}: discovered {r['discovered']}, fetched {r['fetched']}, failed {r['failed']}, saved {r['saved']}")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    recipe, examples = (ml.PAGE, ml.page_examples) if a.kind == "page" else (ml.LINK, ml.link_examples)
    recipe = dataclasses.replace(recipe, iterations=a.iterations) if a.iterations else recipe
    try:
        model, report, validation = ml.train_with_report(examples(rows_of(spark, a.labels)).persist(), recipe)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    os.makedirs(a.output, exist_ok=True)
    model.save(f"{a.output}/model.json")
    with open(f"{a.output}/metrics.json", "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2)
    sinks.json_lines(validation, f"{a.output}/validation.jsonl")
    print(f"threshold {report['threshold']}, average precision {report['average_precision']:.3f}")


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    model, rows = ml.Classifier.load(a.model), rows_of(spark, a.rows)
    if a.kind == "page":
        body = ml.page_text(F.col("title"), F.col("url"), F.col("snippet") if "snippet" in rows.columns else F.lit(""))
    else:
        rows, body = ml.with_link_columns(rows), ml.link_text()
    scored = rows.withColumn("probability", ml.score(model, body))
    sinks.json_lines(scored.withColumn("predicted", F.when(F.col("probability") >= model.threshold, "positive").otherwise("negative")), a.output)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        build(spark, a.pages, a.output)
    elif a.command == "search":
        for r in api.SearchService.load(spark, a.index).search({"q": a.query, "top_n": a.top_n, "context_size": a.context_size}):
            print(f"{r['rank']:3} {r['score']:8.3f} {r['doc']}\n    {r['snippet']}")
    elif a.command == "batch":
        posts, _ = index.load(spark, a.index)
        best = search.top(search.scores(posts, readers.query_batch(spark, a.batch)), a.top_n)
        search.write_run_file(best.withColumn("url", F.col("doc").cast("string")), a.output)
    elif a.command == "report":
        state = crawl.State.read(spark, a.crawl)
        if state is None:
            raise SystemExit(f"{a.crawl} holds no crawl")
        out = report.format_report(state.saved.selectExpr("url as id", "host", "depth as crawl_depth"), state.rejected, state.links)
        print(json.dumps(out, indent=2) if a.json else report.as_text(out))
    elif a.command in ("crawl", "train", "predict"):
        {"crawl": crawl_sites, "train": train, "predict": predict}[a.command](spark, a)
    else:
        routes = api.SearchService.load(spark, a.index).routes()
        if a.labels:
            routes |= api.LabelService(spark, a.labels).routes()
        api.serve(routes, a.port)


if __name__ == "__main__":
    main()
