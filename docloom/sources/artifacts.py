"""What a build leaves behind: tables, a manifest, evaluation sets and pairs in JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

TABLES = ("raw", "documents", "chunks", "postings", "term_df", "doc_len", "corpus_stats", "dense")
REQUIRED = ("chunks", "postings", "doc_len", "dense")

EVAL_SCHEMA = (
    "id string, question string, answers array<string>, gold_chunk_ids array<string>, gold_source_urls array<string>, answerable boolean, "
    "question_type string, answer_style string, required_terms array<string>"
)
PAIR_SCHEMA = "query string, positive string, source_url string, kind string"


def write_table(df: DataFrame, root: str, name: str, sort: tuple[str, ...] = ()) -> None:
    """A table; with `sort` in ranges of it, so that a hot key is in several files and a filter on the key reads few row groups."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks, null text as empty text."""
    return read_table(spark, root, "chunks").na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def check_artifacts(spark: SparkSession, root: str) -> None:
    missing = [n for n in REQUIRED if not exists(spark, f"{root}/{n}")]
    if missing:
        raise FileNotFoundError(f"missing tables under {root}: {', '.join(missing)}")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation items."""
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id string, source_name string, source_url string, title string, section_title string, clean_text string, crawl_depth int, raw_file_path string"
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def write_documents_json(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines in parts, which `read_documents_json` reads, as it reads one JSON array."""
    docs.write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(PAIR_SCHEMA).json(path).where("query is not null")


def jsonable(value: Any) -> Any:
    """Paths to text, tuples and sets to lists, also inside."""
    if isinstance(value, Path):
        return str(value)
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if not isinstance(value, (str, bytes)) and isinstance(value, Iterable):
        return [jsonable(v) for v in value]
    return value


def write_json(value: Any, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(jsonable(value), ensure_ascii=False, indent=2), encoding="utf-8")
