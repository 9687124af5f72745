"""python -m docloom build|crawl|ask|eval|analyze|status|generate-train|train|serve --root FOLDER ..."""

from __future__ import annotations

import argparse
import json

from docloom.operators import evaluation
from docloom.operators.crawl import fetched_pages
from docloom.plans.engine import Engine
from docloom.plans.server import make_server
from docloom.session import local_session
from docloom.sources import artifacts


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("command", choices=("build", "crawl", "ask", "eval", "analyze", "status", "generate-train", "train", "serve"))
    p.add_argument("--root", required=True)
    p.add_argument("--documents", help="parquet table or JSON array of documents, for build")
    p.add_argument("--pages", help="parquet table of pages (source_url, html), for crawl; without it pages are fetched")
    p.add_argument("--sources", help="parquet table of sources, for crawl")
    p.add_argument("--pairs", help="JSON lines of pairs, for train")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--items", help="JSON array or parquet table of evaluation items")
    p.add_argument("--question")
    p.add_argument("--threshold", type=float, default=0.01)
    p.add_argument("--style", default="auto")
    p.add_argument("--sweep", action="store_true")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = local_session("*")
    engine = Engine(spark, a.root)
    items = lambda: artifacts.read_eval_set(spark, a.items) if a.items.endswith(".json") else spark.read.parquet(a.items)
    if a.command == "build":
        out = engine.build(artifacts.read_documents_json(spark, a.documents) if a.documents.endswith(".json") else spark.read.parquet(a.documents))
    elif a.command == "crawl":
        out = engine.build_from_pages(spark.read.parquet(a.pages) if a.pages else fetched_pages(), spark.read.parquet(a.sources))
    elif a.command == "train":
        out = engine.train(artifacts.read_pairs(spark, a.pairs or f"{a.root}/training_pairs"))
    elif a.command == "serve":
        print(f"http://127.0.0.1:{a.port}")
        return make_server(engine, port=a.port).serve_forever()
    elif a.command == "ask":
        out = engine.ask(a.question, a.threshold, a.style)
    elif a.command == "status":
        out = engine.status()
    elif a.command == "generate-train":
        artifacts.write_pairs(engine.training_pairs(items()), a.out or f"{a.root}/training_pairs")
        out = {"written": a.out or f"{a.root}/training_pairs"}
    else:
        from docloom.config import SWEEP_THRESHOLDS

        examples, summaries = engine.evaluate(items(), SWEEP_THRESHOLDS if a.sweep else (a.threshold,))
        if a.command == "analyze":
            out = {r["error_class"]: r["examples"] for r in evaluation.error_histogram(examples).collect()}
        else:
            engine.report(examples, summaries, a.out)
            out = [r.asDict() for r in summaries.orderBy("threshold").collect()]
    print(json.dumps(artifacts.jsonable(out), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
