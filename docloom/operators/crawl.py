"""Crawls: bounded breadth-first search per source over stored or fetched pages, counts, and one page per URL."""

from __future__ import annotations

import http.client
import time
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.html import parse_html
from docloom.functions.urls import document_id, is_valid_url, normalize_url, resolve_link
from docloom.operators.chunking import passed_gate
from docloom.session import cut


def parsed_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages (source_url, html) with normalized URL, title, section_title, clean_text and links, and the columns `keep`."""
    return pages.withColumn("p", parse_html("html")).select(*keep, normalize_url("source_url").alias("url"), "p.title", "p.section_title", "p.clean_text", "p.links")


def page_links(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, link): the distinct valid links of each page, resolved and normalized, for the source of its host."""
    rows = parsed_pages(pages).select("url", F.explode("links").alias("href"))
    found = rows.select("url", normalize_url(resolve_link("url", "href")).alias("link"))
    s = F.broadcast(sources.select("allowed_netloc", "allow_patterns"))  # one row a configured source
    host = F.regexp_extract("link", r"^[^:/?#]+://([^/?#]*)", 1)
    return found.join(s, F.contains(host, F.col("allowed_netloc"))).where(is_valid_url("link", "allowed_netloc", "allow_patterns")).select("url", "link").distinct()


def first_per_url(docs: DataFrame, url_col: str = "source_url", order: tuple[str, ...] = ("crawl_depth", "doc_id")) -> DataFrame:
    """The first page of each normalized URL."""
    w = Window.partitionBy(normalize_url(url_col)).orderBy(*[F.asc_nulls_last(c) for c in order])
    return docs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


Fetch = Callable[[DataFrame], DataFrame]


def stored_pages(pages: DataFrame) -> Fetch:
    """What fetches from a table of pages (source_url, html): a URL leads to the page of the same normal form."""
    own = cut(pages.select(normalize_url("source_url").alias("url"), "html").where("html is not null").groupBy("url").agg(F.min("html").alias("html")))
    return lambda urls: urls.join(own, "url").withColumn("final_url", F.col("url"))


def fetched_pages(timeout: float = 15.0, pause: float = 0.15, agent: str = "docloom-crawler/1.0") -> Fetch:
    """What fetches over HTTP, one page at a time in each task with a pause after each: only status 200 and text/html make a page;
    anything else, failures included, makes none."""

    def get(url: str) -> tuple[str, str] | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                if answer.status == 200 and "text/html" in answer.headers.get("Content-Type", ""):
                    return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.geturl()
        except (OSError, ValueError, http.client.HTTPException):
            return None
        return None

    def fetch(urls: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                got = [get(u) for u in batch["url"]]
                time.sleep(pause * len(batch))
                yield pd.DataFrame({"url": batch["url"], "html": [g and g[0] for g in got], "final": [g and g[1] for g in got]}, dtype=object)

        found = cut(urls.select("url").distinct().mapInPandas(run, "url string, html string, final string")).where("html is not null")
        return urls.join(found.select("url", "html", normalize_url("final").alias("final_url")), "url")

    return fetch


def crawl(pages: DataFrame | Fetch, sources: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of a breadth-first crawl of each source: seeds at depth 0, links of accepted pages up to the greatest
    depth, in the order in which they are found. A source ends with `max_pages_per_source` accepted pages or
    `max_urls_visited_per_source` visited URLs. documents: doc_id, source_name, source_url, title, section_title, clean_text, crawl_depth,
    raw_file_path, html; report: source_name, visited, fetched, accepted.

    Each depth is one round on frames: a URL is visited at its first place in the queue, places are counted on over the rounds
    (a queue of a source holds no more than the links of its accepted pages), and what was visited is anti-joined."""
    fetch = stored_pages(pages) if isinstance(pages, DataFrame) else pages
    s = sources.select("source_name", "allowed_netloc", "allow_patterns")
    seeds = sources.select("source_name", F.posexplode("seed_pages").alias("n", "seed"))
    frontier = seeds.select("source_name", normalize_url("seed").alias("url"), F.array("n").alias("place"))
    visited = taken = None
    by_source = Window.partitionBy("source_name")
    for depth in range(config.max_crawl_depth + 1):
        new = frontier.where("url is not null").groupBy("source_name", "url").agg(F.min("place").alias("place"))
        if visited is not None:
            so_far = visited.groupBy("source_name").agg(F.count(F.lit(1)).alias("seen"), F.count_if("accepted").alias("kept"))
            new = new.join(visited.select("source_name", "url"), ["source_name", "url"], "left_anti").join(so_far, "source_name")
        else:
            new = new.withColumns({"seen": F.lit(0), "kept": F.lit(0)})
        new = new.withColumn("nth", F.col("seen") + F.row_number().over(by_source.orderBy("place", "url"))).where(F.col("nth") <= config.max_urls_visited_per_source)
        got = fetch(new).withColumn("p", parse_html("html")).select("source_name", "url", "final_url", "html", "p.*").withColumn("passed", passed_gate("clean_text", config))
        seen = new.join(got, ["source_name", "url"], "left").withColumn("fetched", F.col("html").isNotNull()).withColumn("accepted", F.coalesce("passed", F.lit(False)))
        # the queue ends after the page that fills the source
        before = F.coalesce(F.sum(F.col("accepted").cast("int")).over(by_source.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("kept")
        seen = seen.withColumn("filed", before).where(F.col("filed") < config.max_pages_per_source).withColumn("crawl_depth", F.lit(depth))
        seen = cut(seen.drop("seen", "kept", "passed"))
        visited = seen.select("source_name", "url", "fetched", "accepted") if visited is None else visited.unionByName(seen.select("source_name", "url", "fetched", "accepted"))
        hit = seen.where("accepted")
        taken = hit if taken is None else taken.unionByName(hit)
        links = hit.select("source_name", "final_url", "nth", F.posexplode("links").alias("n", "href")).select("source_name", normalize_url(resolve_link("final_url", "href")).alias("url"), F.array("nth", "n").alias("place"))
        frontier = links.join(F.broadcast(s), "source_name").where(is_valid_url("url", "allowed_netloc", "allow_patterns")).select("source_name", "url", "place")
    raw = F.format_string("%s_%04d.html", F.regexp_replace(F.lower("source_name"), " ", "_"), F.col("filed"))
    docs = taken.select(document_id("source_name", "final_url").alias("doc_id"), "source_name", F.col("final_url").alias("source_url"), "title", "section_title", "clean_text", "crawl_depth", raw.alias("raw_file_path"), "html", "nth")
    first = Window.partitionBy("source_url").orderBy("source_name", "nth")
    docs = docs.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy", "nth")
    report = s.select("source_name").distinct().join(visited.groupBy("source_name").agg(F.count(F.lit(1)).alias("visited"), F.count_if("fetched").alias("fetched"), F.count_if("accepted").alias("accepted")), "source_name", "left")
    return docs, report.na.fill(0)


def accepted_fetch(status, content_type):
    """Whether a fetch returned a page."""
    return (F.col(status) == 200) & F.contains(F.col(content_type), F.lit("text/html"))


def crawl_counts(fetches: DataFrame) -> DataFrame:
    """(source_name, visited, fetched, accepted) of a fetch log in which a fetch may occur twice: counts of distinct URLs
    in normal form, pre-aggregated by URL so that a hot URL is one row."""
    one = fetches.select("source_name", normalize_url("source_url").alias("url"), F.coalesce(accepted_fetch("http_status", "content_type"), F.lit(False)).alias("ok"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    per_url = one.groupBy("source_name", "url").agg(F.max("ok").alias("ok"), F.max("accepted").alias("accepted"))
    return per_url.groupBy("source_name").agg(F.count(F.lit(1)).alias("visited"), F.count_if("ok").alias("fetched"), F.count_if("accepted").alias("accepted"))
