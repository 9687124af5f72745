"""Streaming ingestion: pages or documents that arrive in a folder become chunks; counts over the fetch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import EngineConfig
from docloom.operators.chunking import build_chunks, passed_gate

DOCUMENT_SCHEMA = "doc_id string, source_name string, source_url string, title string, section_title string, clean_text string, raw_file_path string, crawl_depth int"


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_chunks(docs: DataFrame, table: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Chunks of new documents that pass the gate, appended to `table`. Stateless, exactly once with the file sink."""
    chunks = build_chunks(docs.where(passed_gate("clean_text", config)), config)
    return chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fetch_counts(fetches: DataFrame, late: str = "3 days", window: str = "1 day") -> DataFrame:
    """Accepted and all fetches of each source and window, repeated rows counted once; works on streams and on tables."""
    own = fetches.withWatermark("fetched_at", late) if fetches.isStreaming else fetches
    one = own.dropDuplicatesWithinWatermark(["fetch_id"]) if fetches.isStreaming else own.dropDuplicates(["fetch_id"])
    return one.groupBy(F.window("fetched_at", window).alias("w"), "source_name").agg(F.count(F.lit(1)).alias("fetches"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted")).select("source_name", F.col("w.start").alias("window_start"), "fetches", "accepted")
