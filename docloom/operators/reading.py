"""Reading: the best span of given probabilities, the default lexical reader, and support sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import bind, col, compare_terms, normalize_ws, overlap, split_sentences, terms, word_count
from docloom.operators.sparse import title_terms


def span_search(starts: Column | str, ends: Column | str, top: int = 12, longest: int = 30) -> Column:
    """struct(score, first, last) of the best span: the `top` likeliest starts by the `top` likeliest ends with
    0 <= last - first <= longest and the greatest product; null where there is none. Positions count from 0;
    equal products go to the likelier start, then the likelier end."""

    def likeliest(p: Column) -> Column:
        ranked = F.array_sort(F.transform(col(p), lambda x, i: F.struct((-x.cast("double")).alias("p"), i.alias("i"))))
        return F.slice(ranked, 1, top)

    pairs = F.flatten(F.transform(likeliest(starts), lambda s, si: F.transform(likeliest(ends), lambda e, ei: F.struct((-(s["p"] * e["p"])).alias("p"), si.alias("si"), ei.alias("ei"), s["i"].alias("first"), e["i"].alias("last")))))
    fit = F.filter(pairs, lambda x: (x["last"] >= x["first"]) & (x["last"] - x["first"] <= longest))
    return bind(F.array_min(fit), lambda m: F.when(m.isNotNull(), F.struct((-m["p"]).alias("score"), m["first"].alias("first"), m["last"].alias("last"))))


def read_spans(context: Column | str, offsets: Column | str, starts: Column | str, ends: Column | str) -> Column:
    """struct(answer, score) from the probabilities of a model over the tokens of a context: the text from the start of the first to the
    end of the last token of the best span, ("", 0) for none. `offsets`: array of struct(first, last) characters of each token,
    `last` exclusive."""
    x, o = col(context), col(offsets)

    def cut_out(span: Column) -> Column:
        a, b = F.get(o, span["first"])["first"], F.get(o, span["last"])["last"]
        return F.when(span.isNotNull() & (b > a), normalize_ws(F.substring(x, a + 1, b - a))).otherwise(F.lit(""))

    return bind(span_search(starts, ends), lambda s: bind(cut_out(s), lambda t: F.struct(t.alias("answer"), F.when(t != "", s["score"]).otherwise(F.lit(0.0)).alias("score"))))


def best_sentence(query_terms: Column | str, context: Column | str) -> Column:
    """struct(score, sentence): the first sentence with the largest share of the query's terms; ("", 0) for none."""
    q = col(query_terms)
    scored = F.transform(split_sentences(context), lambda s, i: F.struct(overlap(q, terms(s)).alias("score"), (-i).alias("order"), s.alias("sentence")))
    top = F.array_max(F.filter(scored, lambda x: x["score"] > 0))
    return F.struct(F.coalesce(top["score"], F.lit(0.0)).alias("score"), F.coalesce(top["sentence"], F.lit("")).alias("sentence"))


def lexical_reader(query_terms: Column, context: Column) -> Column:
    """The default reader: struct(answer, score) with the best sentence and the square of its overlap. Lexical, not
    neural; a reader may return null for a candidate, which is then left out."""
    return bind(best_sentence(query_terms, context), lambda b: F.struct(b["sentence"].alias("answer"), F.round(b["score"] * b["score"] * 0.6, 6).alias("score")))


def support_score(q_terms: Column, sentence: Column, t_terms: Column, reranker: Column, hybrid: Column) -> Column:
    s_terms = terms(sentence)
    score = (
        F.lit(0.45) * overlap(q_terms, s_terms) + F.lit(0.20) * F.greatest(reranker, F.lit(0.0)) / 10 + F.lit(0.15) * F.greatest(hybrid, F.lit(0.0))
        + F.lit(0.10) * overlap(q_terms, t_terms) + F.lit(0.10) * F.least(word_count(sentence) / 24, F.lit(1.0))
    )
    return F.when(F.size(s_terms) == 0, F.lit(0.0)).otherwise(score)


_META = ("chunk_id", "source_name", "title", "section_title", "source_url")


def candidate_sentences(reranked: DataFrame) -> DataFrame:
    """The sentences of at least six words of all candidates, each lower-cased text once a question, the first candidate's."""
    rows = reranked.select("*", F.posexplode(split_sentences("chunk_text")).alias("pos", "sentence")).where(word_count("sentence") >= 6)
    first = Window.partitionBy("qid", F.lower("sentence")).orderBy("rerank_rank", "pos")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    score = support_score(F.col("query_terms"), F.col("sentence"), F.col("title_terms"), F.col("reranker_score"), F.col("hybrid_score"))
    return rows.select("qid", "question", "query_terms", "sentence", F.round(score, 4).alias("score"), *_META, "rerank_rank", "pos")


def compared_sentences(reranked: DataFrame, chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """For "difference between A and B": for each term the best sentence that holds it, from all chunks of the URLs of
    the three best candidates, not seen before; B does not take A's sentence."""
    asked = reranked.where("rerank_rank <= 3").withColumn("pair", compare_terms("question")).where("pair is not null")
    urls = asked.select("qid", "query_terms", "pair", "source_url").distinct()
    own = chunks.select(*_META, "chunk_text").join(urls.select("source_url").distinct(), "source_url", "left_semi").dropDuplicates(["chunk_id"])
    rows = urls.join(own, "source_url").withColumn("term", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("pair.left").alias("text")), F.struct(F.lit(2).alias("side"), F.col("pair.right").alias("text")))))
    rows = rows.where(F.contains(F.lower("chunk_text"), F.col("term.text"))).select("*", F.posexplode(split_sentences("chunk_text")).alias("pos", "sentence"))
    rows = rows.where(F.contains(F.lower("sentence"), F.col("term.text")))
    rows = rows.withColumn("low", F.lower("sentence")).join(seen.select("qid", F.lower("sentence").alias("low")).distinct(), ["qid", "low"], "left_anti")
    score = support_score(F.col("query_terms"), F.col("sentence"), title_terms("title", "section_title"), F.lit(1.5), F.lit(0.04)) + F.lit(0.12)
    rows = rows.withColumn("score", F.round(score, 4))
    pick = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id", "pos")
    keep = ["qid", "low", "sentence", "score", *_META, "pos"]
    left = rows.where("term.side = 1").withColumn("nth", F.row_number().over(pick)).where("nth = 1").select(*keep)
    rest = rows.where("term.side = 2").join(left.select("qid", "low"), ["qid", "low"], "left_anti")
    right = rest.withColumn("nth", F.row_number().over(pick)).where("nth = 1").select(*keep)
    return left.withColumn("rerank_rank", F.lit(1000)).union(right.withColumn("rerank_rank", F.lit(1001))).drop("low")


def support_sentences(reranked: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, place, sentence, score, metadata): the best sentences of each question."""
    own = candidate_sentences(reranked)
    rows = own.select("qid", "sentence", "score", *_META, "pos", "rerank_rank").unionByName(compared_sentences(reranked, chunks, own))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rerank_rank", "pos", "chunk_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.support_sentences).drop("pos", "rerank_rank")


def term_definitions(wanted: DataFrame, chunks: DataFrame, says: str = "is primarily") -> DataFrame:
    """(qid, term, definition) of wanted (qid, term, urls): what "term is primarily ..." says up to the next period in the
    first chunk that says it, chunks of `urls` first, then in order of chunk_id; within a chunk ".term" first, then what comes first. A
    term is matched as the end of the text before the phrase, as it is written. Terms meet chunks by an equi-join on the ends of
    the last word before the phrase; only chunks that say the phrase of anything are read and deduplicated."""
    phrase = r"(?U)\s+" + r"\s+".join(re.escape(w) for w in says.split()) + r"\s+"
    said = chunks.select("chunk_id", "source_url", F.lower(normalize_ws("chunk_text")).alias("low")).where(F.col("low").rlike(phrase)).dropDuplicates(["chunk_id"])
    parts = said.select("chunk_id", "source_url", F.split("low", phrase, -1).alias("p")).select("chunk_id", "source_url", "p", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("at", "before"))
    # what follows, over later uses of the phrase if no period comes before them
    after = F.array_join(F.slice("p", F.col("at") + 2, F.size("p")), f" {says} ")
    rows = parts.select("chunk_id", "source_url", "at", "before", normalize_ws(F.regexp_extract(after, r"^([^.]+)", 1)).alias("definition")).where("definition <> ''")
    word = F.regexp_extract("before", r"(\S+)$", 1)
    ends = rows.withColumn("word", word).withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substr(F.col("word"), k)))).where("word <> ''")
    asked = wanted.where("term <> ''").select("qid", "term", "urls", F.regexp_extract("term", r"(\S+)$", 1).alias("end"))
    pairs = ends.join(asked, "end").where(F.endswith("before", F.col("term")))
    dotted = F.endswith("before", F.concat(F.lit("."), F.col("term")))
    first = F.min_by("definition", F.struct((~F.coalesce(F.array_contains("urls", F.col("source_url")), F.lit(False))).alias("other"), "chunk_id", (~dotted).alias("plain"), "at"))
    return pairs.groupBy("qid", "term").agg(first.alias("definition"))
