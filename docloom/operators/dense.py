"""Vectors of chunks and exact maximum inner product search.

The default embedder hashes tokens to signed features and is deterministic; any function from texts to
vectors can take its place. A search is a stated set of query vectors against all rows: the
vectors go to the workers in blocks of a bounded size, one scan a block, each task keeps its own
best k rows a query, and one window ranks what is left, so only queries * k rows a task are shuffled."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.text import tokenize
from docloom.operators.sparse import best
from docloom.operators.topk import CELLS, TopK, grouped

Embedder = Callable[[pd.Series], pd.Series]


def _feature(token: str, dim: int) -> tuple[int, float]:
    """The place and sign of a token: the first four bytes of its MD5 digest and the first bit of the fifth."""
    digest = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:4], "big") % dim, -1.0 if digest[4] & 128 else 1.0


def token_vectors(dim: int = 256, weights: list[float] | None = None) -> Callable[[pa.Array], np.ndarray]:
    """A function from lists of tokens to unit vectors of signed feature counts, each feature times its weight; zeros for null."""
    scale = None if weights is None else np.asarray(weights, np.float64)
    known: dict[str, tuple[int, float]] = {}

    def embed(tokens: pa.Array) -> np.ndarray:
        if len(known) > 200_000:
            known.clear()
        flat = tokens.flatten().dictionary_encode()
        found = [known.get(t) or known.setdefault(t, _feature(t, dim)) for t in flat.dictionary.to_pylist()]
        place, sign = np.array([p for p, _ in found], np.int64), np.array([s for _, s in found])
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        at = flat.indices.to_numpy(zero_copy_only=False)
        v = np.bincount(row * dim + place[at], sign[at], len(tokens) * dim).astype(np.float64, copy=False).reshape(-1, dim)
        v = v if scale is None else v * scale
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        return np.divide(v, norm, out=v, where=norm > 0).astype(np.float32)

    return embed


def hashed_features(dim: int = 256, weights: list[float] | None = None):
    """token_vectors as a pandas UDF."""
    embed = token_vectors(dim, weights)

    @F.pandas_udf("array<float>")
    def of(tokens: pd.Series) -> pd.Series:
        return pd.Series(list(embed(pa.array(tokens, pa.list_(pa.string())))), dtype=object)

    return of


def embed_texts(df: DataFrame, text_col: str, dim: int = 256, out_col: str = "embedding", weights: list[float] | None = None) -> DataFrame:
    return df.withColumn(out_col, hashed_features(dim, weights)(tokenize(F.coalesce(F.col(text_col), F.lit("")))))


def _sparse_block(matrix: np.ndarray):
    """(starts, places, values) of the entries of each row that are not zero, or None where they are no small share."""
    row, place = np.nonzero(matrix)
    if len(row) * 8 > matrix.size:
        return None
    return np.searchsorted(row, np.arange(len(matrix) + 1)), place, matrix[row, place].astype(np.float64)


def _add_scores(top: TopK, norms: np.ndarray, matrix: np.ndarray | None, entries, vectors: np.ndarray) -> None:
    """The inner products of all queries, a matrix or its entries, with the vectors of a group. They are made in single precision, within a bound of the error, and
    those that may be among the best again in double precision."""
    n, dim = vectors.shape
    columns = np.ascontiguousarray(vectors.T.astype(np.float32))
    squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    error = norms * np.sqrt(squares.max(initial=0.0, where=np.isfinite(squares)))
    step = max(1, CELLS // n)
    for first in range(0, len(norms), step):
        rows = min(step, len(norms) - first)
        if entries is None:
            own = matrix[first : first + rows].astype(np.float64)
            scores, terms = own.astype(np.float32) @ columns, dim
            exact = lambda r, c: np.einsum("ij,ij->i", own[r], vectors[c].astype(np.float64))  # noqa: B023, E731
        else:
            starts, place, value = entries
            scores, product = np.zeros((rows, n), np.float32), np.empty(n, np.float32)
            for i in range(rows):
                for j in range(starts[first + i], starts[first + i + 1]):
                    np.multiply(columns[place[j]], np.float32(value[j]), out=product)
                    scores[i] += product
            sizes = np.diff(starts[first : first + rows + 1])
            terms, width = int(sizes.max(initial=0)), np.arange(max(1, int(sizes.max(initial=0))))
            at = np.minimum(starts[first : first + rows, None] + width, max(0, len(place) - 1))
            held = np.where(width < sizes[:, None], value[at], 0.0) if len(place) else np.zeros((rows, 1))
            where = place[at] if len(place) else np.zeros((rows, 1), np.int64)
            exact = lambda r, c: (held[r] * vectors[c[:, None], where[r]]).sum(axis=1)  # noqa: B023, E731
            for i in np.flatnonzero(sizes == 0):
                top.add_equal(first + i, 0.0)
                scores[i] = -np.inf
        margin = error[first : first + rows] * (terms + 4) * 2.0**-23
        top.add(first, scores, margin, -np.inf, exact)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = 16_384, embed: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """(qid, id_col, rank, score) of queries (qid, embedding) against all `vectors`; exact inner products in double
    precision, rounded to six places before ranking; rows without a vector are in no result. A worker holds one
    block of queries, 32 MB at 256 places, or of four times as many where few places are not zero, and rows of one id
    count once. With `embed` the column holds what it makes vectors of, and they are made where they are searched."""
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    found, own = None, []

    def search(own: list) -> DataFrame:
        matrix = np.array([r[1] for r in own])
        entries = _sparse_block(matrix)
        if entries is None and len(own) > block:
            return reduce(DataFrame.union, (search(own[i : i + block]) for i in range(0, len(own), block)))
        ids, norms = [r[0] for r in own], np.linalg.norm(matrix.astype(np.float64), axis=1)
        held = matrix if entries is None else None

        def run(batches):
            top = TopK(len(ids), k, ordered=False)
            for group in grouped(batches):
                names = group.column(0).combine_chunks()
                # in order of the ids, each once
                order = np.unique(pc.rank(names, tiebreaker="dense").to_numpy(), return_index=True)[1]
                of = group.column(1).combine_chunks()
                found = of.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1) if embed is None else embed(of)
                top.begin(names.take(pa.array(order)))
                _add_scores(top, norms, held, entries, found[order] if len(order) < len(names) or (order[1:] < order[:-1]).any() else found)
                top.end()
            yield from top.batches(pa.array(ids, to_arrow_type(queries_kind)), ["qid", id_col, "score"])

        return rows.mapInArrow(run, f"qid {qkind}, {id_col} {kind}, score double")

    queries_kind = queries.schema["qid"].dataType
    number = np.float32 if queries.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    for r in queries.where(F.col("embedding").isNotNull()).select("qid", "embedding").toLocalIterator():
        own.append((r[0], np.asarray(r[1], number)))
        if len(own) == 4 * block:
            found = search(own) if found is None else found.union(search(own))
            own = []
    if own:
        found = search(own) if found is None else found.union(search(own))
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"qid {qkind}, {id_col} {kind}, rank int, score double")
    # parted by question once, for both what follows
    return best(found.repartition("qid").dropDuplicates(["qid", id_col]), k, "score", (id_col,)).select("qid", id_col, "rank", "score")
