"""Pairs of queries and passages for training a retriever."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.dense import embed_texts


def gold_pairs(items: DataFrame, chunks: DataFrame, per_item: int = 3) -> DataFrame:
    """The first chunks, by chunk_id, of the gold URLs of each answerable item."""
    urls = items.where(F.coalesce("answerable", F.lit(True))).select("id", F.col("question").alias("query"), F.explode(F.array_distinct("gold_source_urls")).alias("source_url"))
    own = chunks.select("chunk_id", "source_url", F.col("dense_text").alias("positive")).join(urls.select("source_url").distinct(), "source_url", "left_semi").dropDuplicates(["chunk_id"])
    w = Window.partitionBy("id").orderBy("chunk_id")
    rows = urls.join(own, "source_url").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_item)
    return rows.select("query", "positive", "source_url", F.lit("gold_eval").alias("kind"), F.concat_ws(" ", F.lit("1"), "id", F.format_string("%06d", "nth")).alias("place"))


def synthetic_pairs(chunks: DataFrame, count: int = 120, seed: int = 7) -> DataFrame:
    """Two questions about title and section of each of `count` chunks with the least seeded hashes: a sampling operator.
    The ids are chosen first; texts are read for the chosen ones only."""
    ids = chunks.select("chunk_id").distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "chunk_id"))).orderBy("h", "chunk_id").limit(count)
    chosen = chunks.join(F.broadcast(ids), "chunk_id").dropDuplicates(["chunk_id"])
    text = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    about = F.concat(F.lit("What does "), text("title"), F.lit(" explain in "), text("source_name"), F.lit("?"))
    within = F.concat(F.lit("What is covered in the section "), text("section_title"), F.lit("?"))
    rows = chosen.select(F.posexplode(F.array(about, within)).alias("n", "query"), F.col("dense_text").alias("positive"), "source_url", "chunk_id", "h")
    return rows.select("query", "positive", "source_url", F.lit("synthetic_title_section").alias("kind"), F.concat_ws(" ", F.lit("2"), "h", "chunk_id", "n").alias("place"))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row per (query, source_url), the first by `place`."""
    w = Window.partitionBy("query", "source_url").orderBy("place")
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "place")


def training_pairs(items: DataFrame, chunks: DataFrame) -> DataFrame:
    return distinct_pairs(gold_pairs(items, chunks).unionByName(synthetic_pairs(chunks)))


def fine_tune(pairs: DataFrame, dim: int = 256, most_pairs: int = 20_000, batch: int = 256, epochs: int = 1, rate: float = 0.05, seed: int = 7) -> list[float]:
    """Weights of the hashed features for `embed_texts`, fitted on (query, positive): each query should be nearer to its own
    passage than to the others of its batch (softmax over the inner products of a batch). At most `most_pairs` pairs, in the order of
    their hashes, come to the driver as feature counts: a bounded sample of labelled rows."""
    both = pairs.where("query is not null and positive is not null").select("query", "positive").distinct()
    chosen = both.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "query", "positive"))).limit(most_pairs)
    rows = embed_texts(embed_texts(chosen, "query", dim, "q"), "positive", dim, "p").select("q", "p").collect()
    if not rows:
        raise ValueError("there are no pairs")
    q, p = (np.array([r[k] for r in rows], np.float64) for k in (0, 1))
    w = np.ones(dim)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in np.array_split(order.permutation(len(q)), max(1, len(q) // batch)):
            a, b = q[at], p[at]
            scores = 20.0 * (a * w * w) @ b.T
            share = np.exp(scores - scores.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            # the gradient of the loss by the squared weights: what the batch expects less what is right
            slope = 20.0 * (a * (share @ b - b)).mean(0)
            w = np.sqrt(np.maximum(1e-3, w * w - rate * slope * dim))
    return [float(x) for x in w]
