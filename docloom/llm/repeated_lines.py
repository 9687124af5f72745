"""Problem 6: lines that recur in many pages of one source.

Normalized lines are hashed, the distinct pages per source and hash are counted, hashes above a
share of the source's pages are kept, and a join back names or drops the lines of each page.

Only hashes travel: a page is reduced to one array of 64-bit hashes (a hash covers the source and
the line), which is written to the checkpoint folder and read for the counts and for the join
back. Counts are pre-aggregated before the shuffle, so that a source with a third of all pages
sends at most one row a line and task. The frequent lines number at most 1 / share times the
mean lines a page for each source; the join back is an equi-join on the hash whose build side is
that small set, which adaptive execution broadcasts when its measured size allows and splits by
skew otherwise.

Defined results: a null text has no lines; a null source is a source of its own; each different text
without an id is a page of its own; an id with several texts is one page that has the lines of all, and
each text loses its own lines; repeated rows of one page count once; empty lines are never named.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import free_name, map_lists
from docloom.session import cut

_DIGITS = re.compile(r"[0-9]+")
_BLANKS = re.compile(r"[^\S\n]+")


def line_keys(text: str) -> list[str]:
    """The normalized lines of a text: NFKC, lower case, one space for white space, # for digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _DIGITS.sub("#", _BLANKS.sub(" ", text.lower()))
    return [line.strip() for line in text.split("\n")]


def _hashes(ids, sources, keys, texts):
    out = []
    for source, text in zip(sources, texts):
        seed = 0 if source is None else xxhash.xxh64_intdigest(source.encode()) | 1
        if text is None:
            out.append([])
            continue
        # 0 stands for an empty line; shifted by one bit so that it fits a signed long
        out.append([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed) >> 1 | 1 if k else 0 for k in line_keys(text)])
    return [ids, sources, keys, out]


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source_name", text_col: str = "clean_text") -> DataFrame:
    """(id, source, texts): one row per distinct page, with (key, lines) of each different text: the hash of the text and
    those of its lines in order."""
    key = F.xxhash64(text_col)
    flat = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), F.col(text_col).alias("text"))
    kind = flat.schema["id"].dataType.simpleString()
    rows = map_lists(flat, _hashes, f"id {kind}, source string, key bigint, lines array<bigint>")
    # copies of a page collapse in the task that makes them
    return rows.groupBy("id", "source", F.when(F.col("id").isNull(), F.col("key")).alias("own")).agg(F.collect_set(F.struct("key", "lines")).alias("texts")).drop("own")


def frequent_lines(lines: DataFrame, min_pages: int = 3, min_share: float = 0.10) -> DataFrame:
    """(source, hash, pages): lines in at least `min_pages` pages and `min_share` of the pages of their source."""
    pages = lines.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    counts = (
        lines.select("source", F.explode(F.array_distinct(F.flatten("texts.lines"))).alias("hash"))
        .where("hash <> 0")
        .groupBy("source", "hash")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return (
        counts.alias("c")
        .join(pages.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
        .where(F.col("c.pages") >= F.lit(min_share) * F.col("p.of"))
        .select("c.source", "c.hash", "c.pages")
    )


def _found(docs: DataFrame, id_col: str, source_col: str, text_col: str, min_pages: int, min_share: float) -> DataFrame:
    """(id, source, key, line_no, pages) of every line that recurs too often."""
    lines = cut(hashed_lines(docs, id_col, source_col, text_col))
    frequent = frequent_lines(lines, min_pages, min_share).select("hash", "pages")
    each = lines.select("id", "source", F.explode("texts").alias("t")).select("id", "source", "t.key", F.posexplode("t.lines").alias("pos", "hash"))
    return each.where("hash <> 0").join(frequent, "hash").select("id", "source", "key", (F.col("pos") + 1).cast("int").alias("line_no"), "pages")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source_name", text_col: str = "clean_text", min_pages: int = 3, min_share: float = 0.10) -> DataFrame:
    """(id_col, source_col, line_no, pages, text_key): every non-empty line of every page that recurs too often; text_key tells the
    texts of one id apart."""
    found = _found(docs, id_col, source_col, text_col, min_pages, min_share)
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "line_no", "pages", F.col("key").alias("text_key"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source_name", text_col: str = "clean_text", min_pages: int = 3, min_share: float = 0.10) -> DataFrame:
    """`docs` with `text_col` rebuilt without the lines that recur too often; other columns and rows as they were."""
    found = _found(docs, id_col, source_col, text_col, min_pages, min_share)
    drop, key, src = free_name(docs, "drop"), free_name(docs, "key"), free_name(docs, "src")
    # by source and text: the same text of a source loses the same lines, whatever its id
    gone = found.groupBy(F.col("key").alias(key), F.col("source").alias(src)).agg(F.collect_set("line_no").alias(drop))
    joined = docs.join(gone, F.xxhash64(text_col).eqNullSafe(F.col(key)) & docs[source_col].eqNullSafe(F.col(src)), "left")
    kept = F.array_join(
        F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(F.col(drop), (i + 1).cast("int"))), "\n"
    )
    return joined.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
