"""The engine's queries over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import SWEEP_THRESHOLDS, EngineConfig
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import chunking, crawl, decision, dense, evaluation, fusion, reading, sparse, training
from docloom.plans.answer import answer_many, retrieve, valid_questions
from docloom.session import cut
from docloom.sources import table
from docloom.streaming.ingest import fetch_counts

CONFIG = EngineConfig()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_docs").dropDuplicates(["doc_id"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_chunks")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of a search: valid questions whose id is divisible by 20."""
    return cut(valid_questions(table(spark, d, "questions").where("qid % 20 = 0")))


def _eval_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("id").alias("qid"), "question")


def normalized_text(spark, d):
    return _docs(spark, d).select("doc_id", F.length(T.normalize_ws("clean_text")).alias("n_chars"), F.md5(T.normalize_ws("clean_text")).alias("text_md5"))


def token_lists(spark, d):
    t = T.tokenize("clean_text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def sentence_lists(spark, d):
    return _docs(spark, d).select("doc_id", T.split_sentences("clean_text").alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def question_styles(spark, d):
    pair = T.compare_terms("question")
    return table(spark, d, "questions").where("question is not null").select("qid", T.question_style("question").alias("question_style"), T.expand_query("question").alias("expanded"), F.coalesce(pair["left"], F.lit("")).alias("left_term"), F.coalesce(pair["right"], F.lit("")).alias("right_term"))


def url_forms(spark, d):
    url = U.normalize_url("source_url")
    return table(spark, d, "crawl_docs").select("source_name", "source_url").distinct().select("source_name", "source_url", url.alias("url"), U.document_id("source_name", url).alias("url_doc_id"))


def url_validity(spark, d):
    s = table(spark, d, "sources").select("source_name", "allowed_netloc", "allow_patterns")
    return table(spark, d, "crawl_docs").select("source_name", "source_url").distinct().join(F.broadcast(s), "source_name").select("source_url", U.is_valid_url("source_url", "allowed_netloc", "allow_patterns").alias("valid"))


def first_pages(spark, d):
    return crawl.first_per_url(_docs(spark, d).select("doc_id", "source_url", "crawl_depth")).select("doc_id", "source_url")


def quality_gate(spark, d):
    return _docs(spark, d).select("doc_id", chunking.passed_gate("clean_text").alias("passed"))


def sentence_chunks(spark, d):
    return chunking.build_chunks(_docs(spark, d)).select("chunk_id", "doc_id", "position_in_doc", "token_length", "sentence_count", F.md5("chunk_text").alias("chunk_md5"), F.md5("dense_text").alias("dense_md5"))


def word_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.word_windows("clean_text")).alias("position", "chunk")).select("doc_id", "position", F.md5("chunk").alias("chunk_md5"))


def dense_texts(spark, d):
    return sparse.distinct_chunks(_chunks(spark, d)).select("chunk_id", F.md5(T.dense_text("source_name", "title", "section_title", "chunk_text")).alias("dense_md5"))


def document_frequency(spark, d):
    return sparse.document_frequency(sparse.postings(sparse.chunk_tokens(sparse.distinct_chunks(_chunks(spark, d)))))


def corpus_statistics(spark, d):
    return sparse.corpus_stats(sparse.chunk_tokens(sparse.distinct_chunks(_chunks(spark, d)))).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, d):
    return sparse.bm25_search(_asked(spark, d).select("qid", "question"), _chunks(spark, d))


def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return dense.dense_search(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v, 20, "vec_id")


def bm25_scores(spark, d):
    """The scores that a search reports: with 0.15 of the title overlap."""
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    return sparse.with_title_bonus(sparse.bm25_search(asked.select("qid", "question"), chunks), asked, chunks, "bm25", 0.15).select("qid", "chunk_id", "rank", "score")


def dense_chunks(spark, d):
    """Dense search over the chunks, its scores with 0.10 of the title overlap."""
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    q = dense.embed_texts(asked.select("qid", T.expand_query("question").alias("query")), "query", CONFIG.embedding_dim)
    found = dense.dense_search(q, dense.embed_texts(chunks.select("chunk_id", "dense_text"), "dense_text", CONFIG.embedding_dim), 20)
    return sparse.with_title_bonus(found.withColumnRenamed("score", "similarity"), asked, chunks, "similarity", 0.10).select("qid", "chunk_id", "rank", "score")


def hybrid_rrf(spark, d):
    return retrieve(_asked(spark, d), _chunks(spark, d)).select("qid", "chunk_id", "hybrid_rank", "hybrid_score")


def rerank_topk(spark, d):
    return fusion.rerank(retrieve(_asked(spark, d), _chunks(spark, d))).select("qid", "chunk_id", "rerank_rank", "reranker_score")


def best_sentences(spark, d):
    """For every answered question the sentence of each previewed context that covers most of it."""
    a = table(spark, d, "answers").dropDuplicates(["qid"]).select("qid", "question", F.posexplode("evidence").alias("place", "e"))
    best = reading.best_sentence(T.terms("question"), F.col("e.context_preview"))
    return a.select("qid", "place", best.alias("b")).select("qid", "place", F.round("b.score", 6).alias("score"), "b.sentence")


def span_search(spark, d):
    """The best span over probabilities made of each vector: its squares as starts, those in reverse as ends."""
    sq = F.transform("embedding", lambda x: F.round(x.cast("double") * x.cast("double"), 9))
    return table(spark, d, "embeddings").select("vec_id", reading.span_search(sq, F.reverse(sq)).alias("s")).select("vec_id", F.round("s.score", 9).alias("score"), "s.first", "s.last")


def answer_decisions(spark, d):
    a = table(spark, d, "answers").dropDuplicates(["qid"]).join(table(spark, d, "questions").select("qid", F.coalesce("threshold", F.lit(0.01)).alias("threshold")), "qid")
    best = F.array_max(F.transform("evidence", lambda e, i: F.struct(e["reader_score"].alias("s"), (-i).alias("i"), e.alias("e"))))
    rows = a.withColumn("best", best).withColumn("e", F.col("best.e")).withColumn("support", F.coalesce(F.get("support_sentences", F.lit(0))["score"], F.lit(0.0)))
    chosen = decision.decide("question_style", "final_answer", "support", "e.answer_span", "e.reranker_score", "e.retrieval_score", "e.reader_score", "threshold")
    return rows.withColumn("d", chosen).select("qid", F.col("d.answer_type").alias("decided_type"), F.col("d.final_answer").alias("decided_answer"), F.round("d.confidence", 4).alias("decided_confidence"))


def syntheses(spark, d):
    """Syntheses over the stored support sentences; title and section of the first stand for the definitions of the terms of questions with an odd number."""
    a = table(spark, d, "answers").dropDuplicates(["qid"]).where("question is not null")
    rows = F.coalesce("support_sentences", F.expr("cast(array() as array<struct<sentence:string,score:double,chunk_id:string,source_name:string,title:string,section_title:string,source_url:string>>)"))
    defined = lambda name: F.when(F.col("qid") % 2 == 1, F.coalesce(F.get(F.col("support"), F.lit(0))[name], F.lit("")))
    a = a.withColumn("support", rows)
    return a.select("qid", decision.synthesize("question", "support", defined("title"), defined("section_title")).alias("s")).select("qid", F.col("s.answer").alias("synthesis"), F.round("s.confidence", 6).alias("confidence"))


def answer_metrics(spark, d):
    """Passages of the held-out items as predictions of their answers."""
    rows = table(spark, d, "eval_items").join(table(spark, d, "eval_passages"), F.col("id") == F.col("item_id"))
    return rows.select("id", evaluation.exact_match("passage", "answers").alias("exact_match"), F.round(evaluation.best_f1("passage", "answers"), 6).alias("f1"), F.round(evaluation.term_coverage("passage", "required_terms"), 6).alias("coverage"), F.md5(T.normalize_answer("passage")).alias("normalized_md5"))


def _examples(spark, d) -> DataFrame:
    """Evidence by BM25 for the held-out questions; the first evidence's title as the answer where its score reaches the threshold."""
    items = table(spark, d, "eval_items")
    chunks = sparse.distinct_chunks(_chunks(spark, d)).select("chunk_id", "title", U.normalize_url("source_url").alias("source_url"))
    found = sparse.bm25_search(_eval_questions(spark, d), _chunks(spark, d), k=5).join(chunks, "chunk_id")
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_url", F.coalesce("title", F.lit("")).alias("title"), "bm25"))).alias("evidence"))
    each = items.select("id", F.explode(F.array(*(F.lit(float(t)) for t in SWEEP_THRESHOLDS))).alias("threshold"))
    first = F.get("evidence", F.lit(0))
    ok = F.coalesce(first["bm25"] / 100 >= F.col("threshold"), F.lit(False))
    answers = each.join(rows.withColumnRenamed("qid", "id"), "id", "left").select("id", "threshold", F.when(ok, "answer").otherwise("no_answer").alias("answer_type"), F.when(ok, first["title"]).otherwise(F.lit("")).alias("final_answer"), F.when(ok, first["bm25"]).otherwise(F.lit(0.0)).alias("confidence"), "evidence")
    return evaluation.evaluate(answers, items)


def evaluation_rows(spark, d):
    return _examples(spark, d).select("id", "threshold", "answerable", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "hit_at_1", "hit_at_3", F.round("mrr", 6).alias("mrr"), "no_answer_correct")


def evaluation_summary(spark, d):
    return evaluation.summarize(_examples(spark, d))


def best_threshold(spark, d):
    return evaluation.best_threshold(evaluation.summarize(_examples(spark, d))).select("threshold", "qa_f1")


def error_classes(spark, d):
    return evaluation.error_histogram(cut(_examples(spark, d).where("threshold = 0.0")))


def crawl_report(spark, d):
    return crawl.crawl_counts(table(spark, d, "crawl_fetches"))


def daily_fetches(spark, d):
    return fetch_counts(table(spark, d, "crawl_fetches"))


def gold_pairs(spark, d):
    items, chunks = table(spark, d, "eval_items"), _chunks(spark, d).withColumn("source_url", U.normalize_url("source_url"))
    return training.distinct_pairs(training.gold_pairs(items, chunks)).select("query", "source_url", F.md5("positive").alias("positive_md5"), "kind")


def known_pairs(spark, d):
    """The table of pairs, one row per query and URL."""
    return training.distinct_pairs(table(spark, d, "training_pairs").withColumn("place", F.col("positive"))).select("query", "source_url", F.md5("positive").alias("positive_md5"), "kind")


def training_pairs(spark, d):
    pairs = training.training_pairs(table(spark, d, "eval_items"), _chunks(spark, d).withColumn("source_url", U.normalize_url("source_url")))
    return pairs.select("query", "source_url", F.md5("positive").alias("positive_md5"), "kind")


def page_extract(spark, d):
    return crawl.parsed_pages(table(spark, d, "raw_pages").dropDuplicates(["raw_file_path"]).select("raw_file_path", "source_url", "html"), "raw_file_path").select("raw_file_path", "url", "title", "section_title", F.length("clean_text").alias("n_chars"), F.md5("clean_text").alias("text_md5"), F.size("links").alias("n_links"))


def _site(spark, d) -> tuple[DataFrame, DataFrame]:
    """(pages, sources): a site for each source, whose k-th page (by doc_id) links to the pages 4k+1 to 4k+4; every fifth is too short."""
    own = table(spark, d, "sources").select("source_name", "allowed_netloc", "allow_patterns", F.concat("base_url", F.lit("guide/p")).alias("base"))
    numbered = _docs(spark, d).select("source_name", "doc_id").withColumn("k", F.row_number().over(Window.partitionBy("source_name").orderBy("doc_id")) - 1)
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit('<a href="'), F.col("base"), F.col("k") * 4 + i, F.lit('/#top">next</a>'))), " ")
    body = F.when(F.col("k") % 5 == 4, F.lit("too short")).otherwise(F.concat(F.lit("page of "), F.col("doc_id"), F.repeat(F.lit(" with some words"), 30)))
    html = F.concat(F.lit("<html><head><title>"), F.col("doc_id"), F.lit("</title></head><body><nav>menu</nav><main><h1>Page "), F.col("k"), F.lit("</h1><p>"), body, F.lit("</p></main>"), links, F.lit("</body></html>"))
    pages = numbered.join(F.broadcast(own), "source_name").select(F.concat("base", "k").alias("source_url"), html.alias("html"))
    return pages, own.select("source_name", "allowed_netloc", "allow_patterns", F.array(F.concat("base", F.lit("0")), F.concat("base", F.lit("0#a"))).alias("seed_pages"))


CRAWL = EngineConfig(max_pages_per_source=12, max_urls_visited_per_source=18)


def page_links(spark, d):
    return crawl.page_links(*_site(spark, d))


def crawl_documents(spark, d):
    docs = crawl.crawl(*_site(spark, d), CRAWL)[0]
    return docs.select("doc_id", "source_name", "source_url", "title", "section_title", F.md5("clean_text").alias("text_md5"), "crawl_depth", "raw_file_path")


def crawl_visits(spark, d):
    return crawl.crawl(*_site(spark, d), CRAWL)[1]


def term_definitions(spark, d):
    """What chunks say of a thing that each page says it of: "... is read" in place of "is primarily", which no chunk says."""
    term = F.lower(F.regexp_extract("clean_text", r"([a-zA-Z_.()]+) is read\b", 1))
    wanted = _docs(spark, d).select(F.col("doc_id").alias("qid"), F.array("source_url").alias("urls"), term.alias("term")).where("term <> ''")
    return reading.term_definitions(wanted, _chunks(spark, d), "is read")


def answer_batch(spark, d):
    """Answers to all questions and the held-out ones, with their evidence and support."""
    asked = table(spark, d, "questions").select(F.col("qid").cast("string").alias("qid"), "question", "threshold", "style")
    asked = asked.union(table(spark, d, "eval_items").select("id", "question", F.lit(0.05), "answer_style"))
    got = answer_many(asked, _chunks(spark, d))
    ids = lambda c: F.array_join(F.transform(c, lambda e: e["chunk_id"]), ",")
    tens = lambda c, name: F.array_join(F.transform(c, lambda e: F.round(e[name] * 10000).cast("bigint")), ",")
    return got.select(
        "qid", "question", "question_style", "answer_type", F.md5("final_answer").alias("answer_md5"), F.round(F.col("confidence") * 10000).cast("bigint").alias("confidence"), ids("evidence").alias("evidence"),
        tens("evidence", "retrieval_score").alias("retrieval"), tens("evidence", "reranker_score").alias("reranker"), tens("evidence", "reader_score").alias("reader"),
        F.md5(F.array_join(F.transform("evidence", lambda e: e["answer_span"]), "|")).alias("spans_md5"), F.md5(F.array_join(F.transform("evidence", lambda e: e["context_preview"]), "|")).alias("previews_md5"),
        F.md5(F.array_join(F.transform("support_sentences", lambda e: e["sentence"]), "|")).alias("support_md5"), tens("support_sentences", "score").alias("support"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, normalized_text, token_lists, sentence_lists, question_styles, url_forms, url_validity, first_pages, quality_gate, sentence_chunks, word_chunks, dense_texts,
        document_frequency, corpus_statistics, dense_topk, bm25_scores, dense_chunks, hybrid_rrf, rerank_topk, best_sentences, span_search, answer_decisions, syntheses, answer_metrics, evaluation_rows,
        evaluation_summary, best_threshold, error_classes, crawl_report, daily_fetches, gold_pairs, known_pairs, training_pairs, page_extract, page_links, crawl_documents, crawl_visits, term_definitions, answer_batch,
    )
}
