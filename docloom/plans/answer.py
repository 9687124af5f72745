"""The whole question-answering plan for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import asked_style, bind, compare_terms, expand_query, normalize_ws, overlap, tokenize
from docloom.operators import decision, fusion, reading
from docloom.operators.dense import dense_search, embed_texts, token_vectors
from docloom.operators.sparse import TermIndex, bm25_search
from docloom.session import cut

_META = ("chunk_id", "source_name", "title", "section_title", "source_url")


@dataclass(frozen=True)
class Scorers:
    """What scores passages and reads spans: columns over the candidate rows. The defaults are lexical, not neural.

    `rerank` makes a score of `question` and `passage` (the titled, clipped text); `read` makes struct(answer, score) of the terms of the
    question and the clipped context. A reader of probabilities goes through `reading.read_spans`."""

    rerank: Callable[[], Column] = fusion.lexical_rerank_score
    read: Callable[[Column, Column], Column] = reading.lexical_reader


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions of at least three characters with a threshold in [0, 1] (null: 0.01) and a style (null or unknown: auto)."""
    q = questions.select("qid", normalize_ws("question").alias("question"), F.coalesce("threshold", F.lit(0.01)).alias("threshold"), F.lower("style").alias("style"))
    return q.where((F.length("question") >= 3) & F.col("threshold").between(0, 1)).withColumn("style", F.when(F.col("style").isin("extractive", "explanatory"), F.col("style")).otherwise("auto"))


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, config: EngineConfig = EngineConfig(), index: TermIndex | None = None, weights: list[float] | None = None) -> DataFrame:
    """Hybrid candidates of (qid, question), by the built index and vectors or else from the chunks."""
    embed = token_vectors(config.embedding_dim, weights) if vectors is None else None
    vectors = chunks.select("chunk_id", tokenize(F.coalesce("dense_text", F.lit(""))).alias("embedding")) if vectors is None else vectors
    asked = embed_texts(questions.select("qid", expand_query("question").alias("query")), "query", config.embedding_dim, weights=weights)
    sparse = bm25_search(questions, chunks, config=config, index=index)
    dense = dense_search(asked, vectors, config.top_k_dense, embed=embed)
    return fusion.hybrid_candidates(fusion.fuse(sparse, dense, config.rrf_k), questions, chunks, config)


def read_evidence(reranked: DataFrame, scorers: Scorers = Scorers(), config: EngineConfig = EngineConfig()) -> DataFrame:
    """The first candidates of each question, read: span and combined score; a failed reading drops its candidate."""
    context = F.substring(normalize_ws("chunk_text"), 1, config.max_context_chars)
    rows = reranked.where(F.col("rerank_rank") <= config.evidence_rows).withColumn("context", context)
    rows = rows.withColumn("read", scorers.read(F.col("query_terms"), F.col("context"))).where("read is not null")
    rows = rows.withColumn("fallback", reading.best_sentence("query_terms", "context"))
    title = overlap(F.col("query_terms"), F.col("title_terms"))
    return rows.select(
        "qid", "rerank_rank", *_META, F.round("hybrid_score", 4).alias("retrieval_score"), F.round("reranker_score", 4).alias("reranker_score"),
        decision.combined_reader_score(F.col("read.score"), F.col("fallback.score"), title).alias("reader_score"),
        decision.fallback_span(normalize_ws("read.answer"), F.col("fallback.sentence"), F.col("fallback.score")).alias("answer_span"),
        F.substring("context", 1, 500).alias("context_preview"),
    )


def _gathered(rows: DataFrame, place: str, name: str) -> DataFrame:
    """One ordered array of structs a question; at most a handful of rows each."""
    columns = [c for c in rows.columns if c not in ("qid", place)]
    items = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.struct(*columns).alias("row"))))
    return rows.groupBy("qid").agg(F.transform(items, lambda x: x["row"]).alias(name))


def answer_many(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, scorers: Scorers = Scorers(), config: EngineConfig = EngineConfig(), index: TermIndex | None = None, weights: list[float] | None = None) -> DataFrame:
    """(qid, question, question_style, answer_type, final_answer, confidence, evidence, support_sentences) of each valid
    question of (qid, question, threshold, style). Equal questions are retrieved and read once."""
    asked = cut(valid_questions(questions))
    texts = cut(asked.groupBy("question").agg(F.min("qid").alias("qid")).select("qid", "question"))
    reranked = cut(fusion.rerank(retrieve(texts, chunks, vectors, config, index, weights), scorers.rerank(), config))
    evidence = _gathered(read_evidence(reranked, scorers, config), "rerank_rank", "evidence")
    support_rows = cut(reading.support_sentences(reranked, chunks, config))
    support = _gathered(support_rows.select("qid", "place", "sentence", "score", *_META), "place", "support_sentences")

    pair = texts.withColumn("pair", compare_terms("question", end=r"\?|$")).where("pair is not null")
    urls = support_rows.where("place <= 4").groupBy("qid").agg(F.collect_set("source_url").alias("urls"))
    wanted = pair.join(urls, "qid").select("qid", "urls", F.explode(F.array("pair.left", "pair.right")).alias("term"))
    defined = reading.term_definitions(wanted, chunks).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "definition"))).alias("definitions"))

    one = texts.join(evidence, "qid", "left").join(support, "qid", "left").join(defined, "qid", "left").withColumn("pair", compare_terms("question", end=r"\?|$"))
    define = lambda side: F.try_element_at("definitions", F.col(f"pair.{side}"))
    rows = F.coalesce("support_sentences", F.expr("array()").cast(support.schema["support_sentences"].dataType))
    one = one.withColumn("support_sentences", rows).withColumn("evidence", F.coalesce("evidence", F.expr("array()").cast(evidence.schema["evidence"].dataType)))
    one = one.withColumn("synthesis", decision.synthesize("question", "support_sentences", define("left"), define("right")))
    order = F.transform(F.col("evidence"), lambda e, i: F.struct(e["reader_score"].alias("s"), (-i).alias("i"), e.alias("e")))
    one = one.withColumn("best", bind(F.array_max(order), lambda m: m["e"])).drop("qid", "definitions", "pair")
    full = asked.join(one, "question").withColumn("question_style", asked_style("question", "style"))
    chosen = decision.decide("question_style", "synthesis.answer", "synthesis.confidence", "best.answer_span", "best.reranker_score", "best.retrieval_score", "best.reader_score", "threshold")
    return full.withColumn("d", chosen).select("qid", "question", "question_style", "d.answer_type", "d.final_answer", "d.confidence", "evidence", "support_sentences")
