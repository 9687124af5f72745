"""Metrics of answers against an evaluation set, sweeps of the threshold, and classes of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import ERROR_CLASSES
from docloom.functions.text import bind, col, normalize_answer, words


def _answers(x: Column | str) -> Column:
    return F.coalesce(col(x), F.array().cast("array<string>"))


def exact_match(prediction: Column | str, answers: Column | str) -> Column:
    p = normalize_answer(prediction)
    return F.exists(_answers(answers), lambda a: normalize_answer(a) == p).cast("double")


def token_f1(prediction: Column | str, answer: Column | str) -> Column:
    """F1 over the multisets of normalized tokens; two empty texts are equal, one empty text is not."""

    def score(p: Column, g: Column) -> Column:
        count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
        both = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(count(p, t), count(g, t)))
        f1 = bind(both, lambda b: F.when(b == 0, F.lit(0.0)).otherwise(F.lit(2.0) * (b / F.size(p)) * (b / F.size(g)) / (b / F.size(p) + b / F.size(g))))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(f1)

    return bind(words(normalize_answer(prediction)), lambda p: bind(words(normalize_answer(answer)), lambda g: score(p, g)))


def best_f1(prediction: Column | str, answers: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_answers(answers), lambda a: token_f1(prediction, a))), F.lit(0.0))


def term_coverage(prediction: Column | str, required: Column | str) -> Column:
    p = normalize_answer(prediction)
    hit = F.filter(_answers(required), lambda t: F.contains(p, normalize_answer(t)))
    return F.when(F.size(_answers(required)) > 0, F.size(hit) / F.size(_answers(required))).otherwise(F.lit(0.0))


def retrieval_metrics(evidence: Column | str, gold_ids: Column | str, gold_urls: Column | str) -> Column:
    """struct(hit_at_1, hit_at_3, mrr) of an ordered array of structs with chunk_id and source_url. Without gold, all
    are 1 for no evidence and 0 otherwise."""
    rows = F.coalesce(F.transform(col(evidence), lambda e: F.struct(e["chunk_id"].alias("c"), e["source_url"].alias("u"))), F.array().cast("array<struct<c:string,u:string>>"))
    ids, urls = _answers(gold_ids), _answers(gold_urls)
    gold = F.transform(rows, lambda e: F.coalesce(F.array_contains(ids, e["c"]), F.lit(False)) | F.coalesce(F.array_contains(urls, e["u"]), F.lit(False)))
    first = F.array_position(gold, True)
    none = (F.size(ids) == 0) & (F.size(urls) == 0)
    empty = (F.size(rows) == 0).cast("double")
    at = lambda k: ((first > 0) & (first <= k)).cast("double")
    mrr = F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))
    return F.struct(F.when(none, empty).otherwise(at(1)).alias("hit_at_1"), F.when(none, empty).otherwise(at(3)).alias("hit_at_3"), F.when(none, empty).otherwise(mrr).alias("mrr"))


def evaluate(answers: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (item, answer) of answers (id, threshold, answer_type, final_answer, confidence, evidence) and the evaluation items."""
    rows = items.join(answers, "id")
    m = retrieval_metrics("evidence", "gold_chunk_ids", "gold_source_urls")
    right = (F.col("answer_type") == "no_answer").cast("double")
    able = F.coalesce(F.col("answerable"), F.lit(True))
    return rows.withColumn("m", m).select(
        "id", "question", "threshold", able.alias("answerable"), F.coalesce("question_type", F.lit("extractive")).alias("question_type"), F.col("final_answer").alias("prediction"), "answer_type", "confidence",
        F.when(able, exact_match("final_answer", "answers")).otherwise(right).alias("exact_match"),
        F.when(able, best_f1("final_answer", "answers")).otherwise(right).alias("f1"),
        F.when(able, term_coverage("final_answer", "required_terms")).otherwise(F.lit(0.0)).alias("required_term_coverage"),
        "m.hit_at_1", "m.hit_at_3", "m.mrr", F.when(able, F.lit(0.0)).otherwise(right).alias("no_answer_correct"),
    )


def summarize(examples: DataFrame) -> DataFrame:
    """Macro averages of each threshold, rounded to six places; 0 for an empty group."""
    able, expl = F.col("answerable"), F.col("answerable") & (F.col("question_type") == "explanatory")
    mean = lambda c, who: F.round(F.coalesce(F.avg(F.when(who, F.col(c))), F.lit(0.0)), 6)
    every = F.lit(True)
    return examples.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("example_count"), F.count_if(able).alias("answerable_count"), F.count_if(expl).alias("explanatory_count"), F.count_if(~able).alias("negative_count"),
        mean("exact_match", able).alias("qa_exact_match"), mean("f1", able).alias("qa_f1"), mean("f1", expl).alias("explanatory_f1"), mean("required_term_coverage", expl).alias("explanatory_term_coverage"),
        mean("hit_at_1", able).alias("retrieval_hit_at_1"), mean("hit_at_3", able).alias("retrieval_hit_at_3"), mean("mrr", able).alias("retrieval_mrr"),
        mean("no_answer_correct", ~able).alias("no_answer_accuracy"), mean("f1", every).alias("overall_score"),
    )


def best_threshold(summaries: DataFrame) -> DataFrame:
    """The row of the highest qa_f1, the least threshold of equal ones."""
    return summaries.orderBy(F.desc("qa_f1"), "threshold").limit(1)


def error_class(answerable: Column | str, no_answer_correct: Column | str, hit_at_1: Column | str, f1: Column | str) -> Column:
    able = col(answerable)
    return F.when(~able & (col(no_answer_correct) < 1), "false_positive").when(able & (col(hit_at_1) < 1), "retrieval_miss").when(able & (col(f1) < 1), "reader_or_span_issue").otherwise("ok")


def classified(examples: DataFrame) -> DataFrame:
    return examples.withColumn("error_class", error_class("answerable", "no_answer_correct", "hit_at_1", "f1"))


def error_histogram(examples: DataFrame) -> DataFrame:
    """(error_class, examples): all classes, also those without examples."""
    classes = examples.sparkSession.createDataFrame([(c,) for c in ERROR_CLASSES], "error_class string")
    counts = classified(examples).groupBy("error_class").agg(F.count(F.lit(1)).alias("examples"))
    return classes.join(counts, "error_class", "left").select("error_class", F.coalesce("examples", F.lit(0)).alias("examples"))


def first_of_each_class(examples: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("error_class").orderBy("id")
    return classified(examples).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
