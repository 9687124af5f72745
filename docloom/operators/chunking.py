"""Chunks of documents: windows of sentences, or of words where sentences do not carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import bind, col, dense_text, normalize_ws, split_sentences, tokenize, words
from docloom.functions.urls import chunk_id


def _windows(n: Column, size: int, step: int) -> Column:
    """How many windows of `size` at every `step` cover n items."""
    return (F.lit(1) + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step))).cast("int")


def word_windows(text: Column | str, size: int = 180, overlap: int = 35) -> Column:
    """Windows of `size` words that share `overlap`; the last may be shorter; none for no words."""
    step = max(1, size - overlap)

    def build(w: Column) -> Column:
        k = F.sequence(F.lit(0), _windows(F.size(w), size, step) - 1)
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(k, lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))

    return bind(words(normalize_ws(text)), build)


def sentence_windows(text: Column | str, config: EngineConfig = EngineConfig()) -> Column:
    """Windows of sentences; a short last window joins the one before it, its shared sentences again.
    Word windows where sentences are too many for the words or fewer than a window needs."""
    size, least = config.chunk_max_sentences, config.chunk_min_sentences
    step = max(1, size - config.chunk_sentence_overlap)

    def build(s: Column) -> Column:
        n = F.size(s)
        k = _windows(n, size, step)
        merged = (k > 1) & (n - step * (k - 1) < least)
        window = lambda i: F.array_join(F.slice(s, i * step + 1, F.lit(size)), " ")
        full = F.transform(F.sequence(F.lit(0), F.when(merged, k - 2).otherwise(k - 1)), lambda i: F.when(merged & (i == k - 2), F.concat(window(i), F.lit(" "), window(i + 1))).otherwise(window(i)))
        many = n > F.greatest(F.lit(80), F.floor(F.size(words(normalize_ws(text))) / 6))
        return F.when(many | (n < least), word_windows(text, config.chunk_size_words, config.chunk_overlap_words)).otherwise(full)

    return bind(split_sentences(text), build)


def build_chunks(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per chunk of (doc_id, source_name, title, section_title, source_url, clean_text). No shuffle."""
    parts = docs.withColumn("chunks", sentence_windows("clean_text", config)).select("doc_id", "source_name", "title", "section_title", "source_url", F.posexplode("chunks").alias("position_in_doc", "chunk_text"))
    return parts.select(
        chunk_id("doc_id", "position_in_doc").alias("chunk_id"), "doc_id", "source_name", "title", "section_title", "source_url", "chunk_text",
        F.size(tokenize("chunk_text")).alias("token_length"), F.size(split_sentences("chunk_text")).alias("sentence_count"), "position_in_doc",
        dense_text("source_name", "title", "section_title", "chunk_text").alias("dense_text"),
    )


def passed_gate(text: Column | str, config: EngineConfig = EngineConfig()) -> Column:
    """Whether a page has enough characters and words to be kept."""
    return (F.length(col(text)) >= config.min_clean_chars) & (F.size(words(text)) >= config.min_word_count)
