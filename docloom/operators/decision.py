"""From evidence and support sentences to an answer or none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import bind, col, compare_terms, normalize_ws, strip


def combined_reader_score(reader: Column, fallback: Column, title: Column) -> Column:
    return F.round(F.greatest(reader, F.lit(0.65) * reader + F.lit(0.20) * fallback + F.lit(0.15) * title), 4)


def fallback_span(span: Column, sentence: Column, score: Column) -> Column:
    return F.when((score >= 0.34) & (F.length(span) < 2), sentence).otherwise(span)


def is_low_support(span: Column | str, reranker: Column | str, retrieval: Column | str, reader: Column | str, threshold: Column | str) -> Column:
    """Whether an extracted answer is too weak: rejected by the reranker, found by one retriever only and read with
    little confidence, or empty, all punctuation or a bare small number."""
    text = strip(span)
    weak = col(reader) < 0.2
    return (
        (col(reranker) < 0) | (col(retrieval) < 0.02) & (col(reader) < F.greatest(F.lit(0.15), col(threshold)))
        | (F.length(text) <= 1) & weak | text.rlike(r"(?U)^[\W_]+$") | text.rlike(r"^[0-9]{1,4}$") & weak
    )


def decide(style: Column | str, synthesis: Column | str, confidence: Column | str, span: Column | str, reranker: Column | str, retrieval: Column | str, reader: Column | str, threshold: Column | str) -> Column:
    """struct(answer_type, final_answer, confidence). A synthesis of an explanatory question wins over everything; then an
    extracted span at or above the threshold that is not of low support; else no answer. Null reader: no evidence."""
    synth = (col(style) == "explanatory") & (F.coalesce(col(synthesis), F.lit("")) != "") & (col(confidence) >= F.greatest(F.lit(0.18), col(threshold)))
    none = col(reader).isNull() | (col(reader) < col(threshold)) | is_low_support(F.coalesce(col(span), F.lit("")), reranker, retrieval, reader, threshold)
    out = lambda kind, text, score: F.struct(F.lit(kind).alias("answer_type"), text.alias("final_answer"), score.cast("double").alias("confidence"))
    return F.when(synth, out("answer", col(synthesis), F.round(col(confidence), 4))).when(none, out("no_answer", F.lit(""), F.lit(0.0))).otherwise(out("answer", col(span), col(reader)))


def synthesize(question: Column | str, support: Column | str, left_definition: Column | str, right_definition: Column | str) -> Column:
    """struct(answer, confidence) from the support sentences (an ordered array of structs with sentence and score).

    A comparison with both definitions states them; with a sentence for each term it sets them beside each other; otherwise
    the sentences of the terms come first. Anything else joins the three best. With a single sentence that names both terms its
    score is the confidence."""
    low, rows = F.lower(col(question)), col(support)
    sentences = F.transform(rows, lambda r: r["sentence"])
    scores = F.transform(rows, lambda r: r["score"])
    asks = low.contains("difference between") | low.contains("compare") | low.contains(" versus ") | low.contains(" vs ")
    pair = F.when(asks, compare_terms(question, end=r"\?|$"))
    ld, rd = F.coalesce(col(left_definition), F.lit("")), F.coalesce(col(right_definition), F.lit(""))
    cap = lambda c: F.least(F.lit(0.99), c)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = lambda n: bind(F.slice(scores, 1, n), lambda a: total(a) / F.greatest(F.size(a), F.lit(1)))
    out = lambda a, c: F.struct(normalize_ws(a).alias("answer"), c.alias("confidence"))
    holds = lambda t: F.filter(sentences, lambda s: F.contains(F.lower(s), t))

    prefix = F.when(low.contains("why"), "Based on the documentation, ").when(low.contains("how"), "According to the retrieved documentation, ").otherwise("")

    def plain(chosen: Column) -> Column:
        joined = normalize_ws(F.array_join(chosen, " "))
        lowered = F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))
        return out(F.when((prefix != "") & (joined != ""), F.concat(prefix, lowered)).otherwise(joined), cap(mean(3)))

    def compared(p: Column) -> Column:
        left, right = holds(p["left"]), holds(p["right"])
        defined = F.concat(p["left"], F.lit(" is primarily "), ld, F.lit(", while "), p["right"], F.lit(" is primarily "), rd, F.lit(". Use "), p["left"], F.lit(" when you want "), ld, F.lit(", and use "), p["right"], F.lit(" when you want "), rd, F.lit("."))
        beside = F.concat(p["left"], F.lit(" is described as "), F.btrim(F.get(left, F.lit(0)), F.lit(". ")), F.lit(" while "), p["right"], F.lit(" is described as "), F.btrim(F.get(right, F.lit(0)), F.lit(". ")))
        first = F.concat(F.slice(left, 1, 1), F.slice(right, 1, 1))
        rest = F.filter(F.slice(sentences, 1, 3), lambda s: ~F.array_contains(first, s))
        return (
            F.when((ld != "") & (rd != ""), out(defined, cap(F.array_max(F.slice(scores, 1, 2)))))
            .when((F.size(left) > 0) & (F.size(right) > 0), out(beside, cap(mean(2))))
            .otherwise(plain(F.slice(F.concat(first, rest), 1, 3)))
        )

    done = F.when(pair.isNotNull(), bind(pair, compared)).otherwise(plain(F.slice(sentences, 1, 3)))
    return F.when(F.size(rows) > 0, done).otherwise(F.struct(F.lit("").alias("answer"), F.lit(0.0).alias("confidence")))
