"""Settings of the engine and the fixed values of its rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    max_pages_per_source: int = 60
    max_urls_visited_per_source: int = 280
    max_crawl_depth: int = 2
    min_clean_chars: int = 140
    min_word_count: int = 40
    chunk_size_words: int = 180
    chunk_overlap_words: int = 35
    chunk_min_sentences: int = 4
    chunk_max_sentences: int = 8
    chunk_sentence_overlap: int = 2
    top_k_bm25: int = 20
    top_k_dense: int = 20
    top_k_rerank: int = 7
    evidence_rows: int = 5
    support_sentences: int = 6
    max_context_chars: int = 2200
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    embedding_dim: int = 256
    #: Questions answered in one plan; larger batches are run in blocks of this size.
    question_block: int = 2000
    #: Query-term rows that are searched at once, and ids of found chunks that are broadcast: 84 MB as a hashed relation, as
    #: measured with query-term rows.
    broadcast_rows: int = 500_000
    #: Different query terms up to which they are a filter of the scan.
    filter_terms: int = 5000


# Words left out of tokens.
STOPWORDS = (
    "a an the and or but if then else for to of in on at by with from as is are was were be been being that this these those it its "
    "into than can could should would may might will shall do does did how what which when where why who whom about through using use"
).split()

# Markers of a question that asks for an explanation.
EXPLANATORY_MARKERS = ("why", "how", "difference between", "compare", "when should", "when is each", "explain", "what happens", "recommended", "best way", "versus", "vs")

# Phrases of a question and the words added to its query.
QUERY_EXPANSIONS = {
    "response model": "response_model pydantic schema",
    "csv": "read_csv to_csv csv",
    "parquet": "read_parquet to_parquet parquet",
    "headers": "response headers header response",
    "stream": "StreamingResponse stream yield",
    "index and value": "enumerate index value",
    "two sequences": "zip iterable sequence",
    "group rows": "groupby split apply combine",
    "dictionary key and value": "items key value dictionary",
}

# Libraries whose names are dropped from the terms of a comparison.
COMPARE_CONTEXTS = ("pandas", "fastapi", "python", "pydantic")

# File extensions that are no pages.
BANNED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".tar", ".gz", ".pdf", ".xml", ".css", ".js")

# Lines of a page that are dropped.
NOISE_LINES = ("table of contents", "previous", "next", "contents", "navigation", "search", "skip to content", "edit on github", "view page source")

# Elements and classes of a page that are dropped with all they hold.
DROPPED_TAGS = ("nav", "header", "footer", "aside")
DROPPED_CLASSES = (
    "sidebar", "sphinxsidebar", "wy-nav-side", "related", "toctree-wrapper", "toc", "breadcrumbs", "headerlink", "search",
    "mobile-nav", "topbar", "navbar", "prev-next-area", "rst-footer-buttons", "bd-sidebar", "bd-header", "bd-footer",
)

# Elements, classes and roles that may hold the main part of a page.
MAIN_TAGS = ("main", "article")
MAIN_CLASSES = ("document", "body", "content", "section", "bd-content", "sk-page-content")

# Thresholds of the sweep of the evaluation.
SWEEP_THRESHOLDS = (0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25)

# The classes of the error report, in its order.
ERROR_CLASSES = ("retrieval_miss", "reader_or_span_issue", "false_positive", "ok")
