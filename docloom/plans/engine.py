"""The engine: build an index over documents, ask it, evaluate it."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import ERROR_CLASSES, SWEEP_THRESHOLDS, EngineConfig
from docloom.operators import evaluation, training
from docloom.operators.chunking import build_chunks
from docloom.operators.crawl import Fetch, crawl, first_per_url
from docloom.operators.dense import embed_texts
from docloom.operators.sparse import TermIndex, chunk_tokens, corpus_stats, document_frequency, postings
from docloom.plans.answer import Scorers, answer_many
from docloom.session import cut
from docloom.sources import artifacts


class Engine:
    """One folder of tables and what is done with it."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), scorers: Scorers = Scorers()) -> None:
        self.spark, self.root, self.config, self.scorers = spark, root, config, scorers

    def build(self, docs: DataFrame, report: list[dict] | None = None) -> dict:
        """Chunks, postings and vectors of documents; returns the manifest. RuntimeError without documents or chunks."""
        if docs.isEmpty():
            raise RuntimeError("there are no documents")
        self._write(first_per_url(docs), "documents")
        self._write(build_chunks(self._read("documents"), self.config), "chunks")
        chunks = self._read("chunks")
        if chunks.isEmpty():
            raise RuntimeError("no chunks were made")
        tokens = cut(chunk_tokens(chunks))
        self._write(postings(tokens), "postings", sort=("term", "chunk_id"))
        self._write(document_frequency(self._read("postings")), "term_df", sort=("term",))
        self._write(tokens.select("chunk_id", "dl"), "doc_len")
        self._write(corpus_stats(tokens), "corpus_stats")
        self.rebuild_dense()
        manifest = {
            "config": dataclasses.asdict(self.config), "crawl_report": report or {"mode": "given documents"}, "document_count": self._read("documents").count(), "chunk_count": chunks.count(),
            "tables": {n: f"{self.root}/{n}" for n in artifacts.TABLES}, "models": {"embedder": "hashed features", "reranker": "lexical", "reader": "lexical"},
        }
        artifacts.write_text(self.spark, json.dumps(artifacts.jsonable(manifest), ensure_ascii=False), f"{self.root}/manifest")
        return manifest

    def _write(self, df: DataFrame, name: str, **options) -> None:
        artifacts.write_table(df, self.root, name, **options)

    def _read(self, name: str) -> DataFrame:
        return artifacts.read_table(self.spark, self.root, name)

    def weights(self) -> list[float] | None:
        """The fitted weights of the embedder, null before `train`."""
        if not artifacts.exists(self.spark, f"{self.root}/embedder"):
            return None
        return [r["weight"] for r in self._read("embedder").orderBy("place").collect()]

    def rebuild_dense(self) -> None:
        """The vectors of all chunks, by the embedder as it is now."""
        texts = self._read("chunks").select("chunk_id", "dense_text")
        self._write(embed_texts(texts, "dense_text", self.config.embedding_dim, weights=self.weights()).select("chunk_id", "embedding"), "dense")

    def train(self, pairs: DataFrame) -> dict:
        """Fit the embedder on pairs (query, positive), keep its weights as a table and rebuild the vectors."""
        weights = training.fine_tune(pairs, self.config.embedding_dim)
        self._write(self.spark.createDataFrame(list(enumerate(weights)), "place int, weight double").coalesce(1), "embedder")
        self.rebuild_dense()
        return {"status": "ok", "trained_pairs": pairs.count(), "table": f"{self.root}/embedder"}

    def build_from_pages(self, pages: DataFrame | Fetch, sources: DataFrame) -> dict:
        """A crawl over stored pages (or by a fetcher), its raw pages kept by path, and a build over its documents."""
        docs, report = crawl(pages, sources, self.config)
        docs = cut(docs)
        self._write(docs.select("raw_file_path", "source_url", "html"), "raw")
        return self.build(docs.drop("html"), [r.asDict() for r in report.orderBy("source_name").collect()])

    def chunks(self) -> DataFrame:
        artifacts.check_artifacts(self.spark, self.root)
        return artifacts.read_chunks(self.spark, self.root)

    def index(self) -> TermIndex:
        return TermIndex(self._read("postings"), self._read("term_df"), self._read("corpus_stats"))

    def answers(self, questions: DataFrame) -> DataFrame:
        """Answers to (qid, question, threshold, style), from the built postings and vectors: no chunk is tokenized or embedded
        but those that come into question."""
        return answer_many(questions, self.chunks(), self._read("dense"), self.scorers, self.config, self.index(), self.weights())

    def answer_table(self, questions: DataFrame, path: str) -> DataFrame:
        """Answers to any number of questions, `question_block` at a time, each block appended to the table at `path`."""
        questions = cut(questions)
        blocks = max(1, -(-questions.count() // self.config.question_block))
        for k in range(blocks):
            self.answers(questions.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == k)).write.mode("append" if k else "overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def ask(self, question: str, threshold: float = 0.01, style: str = "auto") -> dict:
        if len(question or "") < 3:
            raise ValueError("a question has at least three characters")
        if not 0 <= threshold <= 1:
            raise ValueError("the threshold is between 0 and 1")
        row = self.answers(self.spark.createDataFrame([(1, question, float(threshold), style)], "qid bigint, question string, threshold double, style string")).drop("qid").first()
        if row is None:
            raise ValueError("a question has at least three characters")
        return row.asDict(recursive=True)

    def evaluate(self, items: DataFrame, thresholds: tuple[float, ...] = (0.01,)) -> tuple[DataFrame, DataFrame]:
        """(examples, summaries) at each threshold; questions are retrieved and read once for all thresholds."""
        each = items.select("id", "question", F.coalesce("answer_style", F.lit("auto")).alias("style"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
        each = each.select(F.concat_ws("\x00", "id", F.col("threshold").cast("string")).alias("qid"), "*")
        got = self.answers(each).join(each.select("qid", "id", "threshold"), "qid").select("id", "threshold", "answer_type", "final_answer", "confidence", "evidence")
        examples = cut(evaluation.evaluate(got, items))
        return examples, evaluation.summarize(examples)

    def sweep(self, items: DataFrame) -> DataFrame:
        return evaluation.best_threshold(self.evaluate(items, SWEEP_THRESHOLDS)[1])

    def training_pairs(self, items: DataFrame) -> DataFrame:
        return training.training_pairs(items, self.chunks())

    def status(self) -> dict:
        found = {n: artifacts.exists(self.spark, f"{self.root}/{n}") for n in (*artifacts.REQUIRED, "manifest")}
        return {"ready": all(found[n] for n in artifacts.REQUIRED), **found}

    @staticmethod
    def report(examples: DataFrame, summaries: DataFrame, path: str | Path | None = None) -> str:
        """A Markdown report of summaries, classes of errors and the first failed questions, small results only; beside it
        the summaries and counts as JSON."""
        lines = ["# Evaluation report", "", "| threshold | exact match | F1 | hit@1 | hit@3 | MRR | no answer | overall |", "|" + "---|" * 8]
        for r in summaries.orderBy("threshold").collect():
            lines.append("| " + " | ".join(f"{r[c]:.4f}" for c in ("threshold", "qa_exact_match", "qa_f1", "retrieval_hit_at_1", "retrieval_hit_at_3", "retrieval_mrr", "no_answer_accuracy", "overall_score")) + " |")
        first = summaries.orderBy("threshold").first()
        own = examples.where(F.col("threshold") == first["threshold"]) if first else examples
        counts = {r["error_class"]: r["examples"] for r in evaluation.error_histogram(own).collect()}
        lines += ["", "## Errors", "", *(f"- {c}: {counts.get(c, 0)}" for c in ERROR_CLASSES), "", "## First failed questions", ""]
        lines += [f"- {r['id']}: {r['question']} ({r['error_class']}, F1 {r['f1']:.4f})" for r in evaluation.first_of_each_class(own).where("error_class <> 'ok'").orderBy("error_class", "place").collect()]
        text = "\n".join(lines) + "\n"
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(text, encoding="utf-8")
            rows = {"summaries": [r.asDict() for r in summaries.orderBy("threshold").collect()], "errors": {c: counts.get(c, 0) for c in ERROR_CLASSES}}
            artifacts.write_json(rows, Path(path).with_suffix(".json"))
        return text
