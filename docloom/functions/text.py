"""Text rules as columns: white space, tokens, sentences, question style, query expansion, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import COMPARE_CONTEXTS, EXPLANATORY_MARKERS, QUERY_EXPANSIONS, STOPWORDS

_WORDS = r"(?U)\s+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once: a let-binding as a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def normalize_ws(x: Column | str) -> Column:
    """CR to LF, runs of blanks and tabs to one space, at most one empty line, no white space at the ends."""
    x = F.regexp_replace(col(x), "\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def words(x: Column | str) -> Column:
    return F.filter(F.split(col(x), _WORDS), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


def stopword_array() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def tokenize(x: Column | str) -> Column:
    """Lower-case tokens of ASCII letters, digits and _/.+- without stop words. White space parts tokens in any form, so it
    need not be normalized first."""
    found = F.regexp_extract_all(F.lower(col(x)), F.lit("([a-z0-9_/.+-]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def terms(x: Column | str) -> Column:
    return F.array_distinct(tokenize(x))


def split_sentences(x: Column | str) -> Column:
    """Sentences at . ! ? and line ends; parts of fewer than eight words without an end mark join the next part."""
    texts = F.filter(F.transform(F.split(normalize_ws(x), r"(?U)(?<=[.!?])\s+|\n+"), normalize_ws), lambda p: p != "")
    # words are counted once a part: those of joined parts add up
    parts = F.transform(texts, lambda p: F.struct(p.alias("text"), F.size(F.split(p, _WORDS)).alias("n"), F.substring(p, -1, 1).isin(".", "!", "?").alias("ends")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        n = acc["n"] + part["n"]
        hold = (n < 8) & ~part["ends"]
        joined = F.when(acc["held"] == "", part["text"]).otherwise(F.concat(acc["held"], F.lit(" "), part["text"]))
        done = F.when(hold, acc["done"]).otherwise(F.array_append(acc["done"], joined))
        return F.struct(done.alias("done"), F.when(hold, joined).otherwise(F.lit("")).alias("held"), F.when(hold, n).otherwise(F.lit(0)).alias("n"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.element_at(acc["done"], -1), F.lit(" "), acc["held"])
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))
        return F.when(acc["held"] == "", acc["done"]).when(n == 0, F.array(acc["held"])).otherwise(joined)

    return F.when(col(x).isNotNull(), F.aggregate(parts, start, step, finish))


def question_style(question: Column | str) -> Column:
    return F.when(F.lower(col(question)).rlike("|".join(map(re.escape, EXPLANATORY_MARKERS))), "explanatory").otherwise("extractive")


def asked_style(question: Column | str, style: Column | str) -> Column:
    """The style asked for where it is one, else that of the question."""
    return F.when(col(style).isin("extractive", "explanatory"), col(style)).otherwise(question_style(question))


def compare_term(term: Column | str) -> Column:
    """A term of a comparison, without context words and what follows it."""
    x = F.lower(normalize_ws(term))
    x = F.btrim(x, F.lit(" .?"))
    x = F.regexp_replace(x, rf"(?U)\b(in|with|for|within)\s+({'|'.join(COMPARE_CONTEXTS)})\b", "")
    x = F.regexp_replace(x, r"(?Um)\b(and|when|why|how|used|recommended|should|is each|each)\b.*$", "")
    x = F.regexp_replace(x, r"[^a-z0-9_./+-]+$", "")
    return F.btrim(normalize_ws(x), F.lit(" .?,"))


def compare_terms(question: Column | str, end: str = r",|\?|$") -> Column:
    """struct(left, right) of "difference between A and B", null where the question does not ask so."""
    low = F.lower(col(question))
    pattern = rf"difference between (.+?) and (.+?)(?:{end})"
    pair = F.struct(compare_term(F.regexp_extract(low, pattern, 1)).alias("left"), compare_term(F.regexp_extract(low, pattern, 2)).alias("right"))
    return F.when(low.rlike(pattern), pair)


def expand_query(question: Column | str) -> Column:
    """The question, the expansions of its phrases and its first four identifiers, each part once."""
    q = col(question)
    extra = [F.when(F.lower(q).contains(phrase), F.lit(words_)) for phrase, words_ in QUERY_EXPANSIONS.items()]
    names = F.slice(F.regexp_extract_all(q, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), 1, 4)
    parts = F.filter(F.concat(F.array(q, *extra), names), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(parts), " ")


def overlap(left: Column, right: Column) -> Column:
    """The share of the distinct terms `left` that are in `right`."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.lit(1))


def dense_text(source: Column | str, title: Column | str, section: Column | str, text: Column | str) -> Column:
    line = lambda name, x: F.when(col(x) != "", F.concat(F.lit(f"{name}: "), col(x)))
    return strip(F.concat_ws("\n", line("Source", source), line("Document", title), line("Section", section), col(text)))


def passage_pair(title: Column | str, section: Column | str, text: Column | str, size: int = 2200) -> Column:
    """What a plugged-in reranker reads beside the question."""
    return F.concat(F.lit("Title: "), F.coalesce(col(title), F.lit("")), F.lit("\nSection: "), F.coalesce(col(section), F.lit("")), F.lit("\nPassage: "), F.substring(normalize_ws(text), 1, size))


def normalize_answer(x: Column | str) -> Column:
    """Lower case without articles and ASCII punctuation, words separated by one space."""
    x = F.regexp_replace(F.lower(col(x)), r"(?U)\b(a|an|the)\b", " ")
    x = F.regexp_replace(x, r"""[!-/:-@\[-`{-~]""", "")
    return F.array_join(words(x), " ")
