"""Reciprocal-rank fusion of two ranked lists, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import expand_query, normalize_ws, overlap, passage_pair, terms
from docloom.operators.sparse import best, found_chunks, title_terms
from docloom.session import cut


def fuse(sparse: DataFrame, dense: DataFrame, k: int = 60) -> DataFrame:
    """(qid, chunk_id, sparse_rank, dense_rank, rrf): all chunks of either list."""
    both = sparse.select("qid", "chunk_id", F.col("rank").alias("sparse_rank")).join(dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank")), ["qid", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", part("sparse_rank") + part("dense_rank"))


def hybrid_candidates(fused: DataFrame, questions: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best candidates of each question with their chunk: fusion plus a tenth of the title overlap.
    Titles are joined by id to at most 40 rows a question, texts to those that are ranked."""
    fused = cut(fused)
    titles = found_chunks(chunks.select("chunk_id", "title", "section_title"), fused, config).select("chunk_id", title_terms("title", "section_title").alias("title_terms"))
    q = questions.select("qid", "question", terms(expand_query("question")).alias("expanded_terms"), terms("question").alias("query_terms"))
    rows = fused.join(titles, "chunk_id").join(q, "qid")
    scored = rows.withColumn("hybrid_score", F.round(F.col("rrf") + F.lit(0.10) * overlap(F.col("expanded_terms"), F.col("title_terms")), 6))
    ranked = best(scored, max(config.top_k_bm25, config.top_k_dense), "hybrid_score").withColumnRenamed("rank", "hybrid_rank")
    # texts only meet what is ranked
    ranked = cut(ranked.select("qid", "chunk_id", "question", "expanded_terms", "query_terms", "title_terms", "hybrid_score", "hybrid_rank"))
    meta = found_chunks(chunks.select("chunk_id", "source_name", "title", "section_title", "source_url", "chunk_text"), ranked, config)
    return ranked.join(meta, "chunk_id")


def lexical_rerank_score() -> Column:
    """The default reranker: term overlap of question and titled passage, below zero without any. Lexical, not neural."""
    body = overlap(F.col("query_terms"), terms(F.substring(normalize_ws("chunk_text"), 1, 2200)))
    title = overlap(F.col("query_terms"), F.col("title_terms"))
    return F.when((body == 0) & (title == 0), F.lit(-1.0)).otherwise(F.lit(8.0) * body + F.lit(2.0) * title)


def rerank(candidates: DataFrame, score: Column | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best candidates by the reranker. A plugged-in score is a column over `question` and `passage`, the titled and clipped text."""
    if score is not None:
        candidates = candidates.withColumn("passage", passage_pair("title", "section_title", "chunk_text", config.max_context_chars))
    scored = candidates.withColumn("reranker_score", F.round(lexical_rerank_score() if score is None else score, 6)).drop("passage")
    return best(scored, config.top_k_rerank, "reranker_score").withColumnRenamed("rank", "rerank_rank")
