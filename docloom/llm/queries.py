"""The queries of the training-text operators over the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import boilerplate, leakage, markup, mixing, near_duplicates, personal, repeated_lines, sentences, splitting
from docloom.sources import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs").select("doc_id", "clean_text", "raw_file_path")
    return boilerplate.boilerplate_lines(docs, table(spark, folder, "raw_pages").select("raw_file_path", "html"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    limits = {r["field_name"]: (r["max_chars"], r["overlap_chars"]) for r in table(spark, folder, "size_limits").collect()}
    out = []
    for field, name, key in (("clean_text", "crawl_docs", "doc_id"), ("dense_text", "processed_chunks", "chunk_id")):
        pieces = splitting.split_oversized(table(spark, folder, name).select(key, field), field, *limits[field], only_oversized=True, with_text=False)
        out.append(pieces.where("n_pieces > 1 and piece_no = 0").select(F.lit(field).alias("field_name"), F.col(key).alias("item_id")).distinct())
    return out[0].union(out[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs").select("doc_id", "clean_text")
    members, pairs = near_duplicates.near_duplicate_pairs(docs, threshold=0.6, words=3)
    return near_duplicates.document_pairs(members, pairs).toDF("doc_id_a", "doc_id_b")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs").select("doc_id", "source_name", "clean_text")
    return repeated_lines.repeated_lines(docs).select("doc_id", "line_no").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs").select("doc_id", "clean_text")
    sample = table(spark, folder, "sentence_sample").select("doc_id", "lang").dropDuplicates(["doc_id"])
    judged = docs.join(sample, "doc_id").dropDuplicates(["doc_id"])
    return sentences.sentence_units(judged, lang_col="lang", corpus=docs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.residue_rows(table(spark, folder, "crawl_docs"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("id").alias("item_id"), F.col("question").alias("passage"))
    return items.union(table(spark, folder, "eval_passages").select("item_id", "passage"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), _items(spark, folder))


def p7_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold fifty letters and digits of an item with at most one edit."""
    return leakage.leaked_items(table(spark, folder, "documents"), _items(spark, folder), max_edits=1)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each item leaked."""
    return leakage.leak_report(p7_found(spark, folder), _items(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path = os.environ.get("DOCLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), path)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_spans(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p7_edited, p7_report, p8_mix, p8_shares, p9_found)}

_WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: SQL for DuckDB by brute force. The other operators, which SQL does not state (Unicode NFKC, tokenizers, rules of language),
#: are tested against brute force and fixtures in tests/llm.
ORACLES: dict[str, str] = {
    "p2_found": """SELECT DISTINCT 'clean_text' AS field_name, doc_id AS item_id FROM crawl_docs WHERE length(clean_text) > (SELECT max_chars FROM size_limits WHERE field_name = 'clean_text')
        UNION ALL SELECT DISTINCT 'dense_text', chunk_id FROM processed_chunks WHERE length(dense_text) > (SELECT max_chars FROM size_limits WHERE field_name = 'dense_text')""",
    "p3_found": f"""WITH docs AS (SELECT DISTINCT doc_id, clean_text FROM crawl_docs),
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(clean_text), '{_WS}'), lambda x: x <> '') AS w FROM docs),
        g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL)
        SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c)""",
}
