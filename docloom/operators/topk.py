"""The best rows of many queries, kept while the rows of one task go by, so that a task gives k rows a query however
many rows it scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are scored at once, and scores held at once.
GROUP_ROWS, CELLS = 16_384, 1 << 19


def grouped(batches, rows: int = GROUP_ROWS):
    """Arrow batches joined until they have `rows` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class TopK:
    """The k best (score, id) of each of n queries; equal scores in order of ids, an id once. `ordered`: ids come in their
    order and each once, so that what comes later loses a tie."""

    def __init__(self, n: int, k: int, ordered: bool):
        self.k, self.ordered = k, ordered
        self.scores, self.places = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.ids, self.seen, self.hits = [], 0, []

    def begin(self, ids: pa.Array) -> None:
        """Starts a group of rows with these ids, in their order, each once."""
        self.ids.append(ids)

    def add(self, first: int, scores: np.ndarray, margin: np.ndarray | float, least: float, exact) -> None:
        """Scores of the queries from `first` on against the rows of the group, each within `margin` of exact(rows, columns).
        Scores up to `least` are of no pair."""
        own, n = self.k, scores.shape[1]
        margin = np.broadcast_to(np.asarray(margin, np.float64) + 1e-6, (len(scores),))  # and what rounding adds
        bound = self.scores[first : first + len(scores), own - 1] - margin
        hit = (scores >= bound[:, None].astype(scores.dtype)) & (scores > least)
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * own)
        for i in many:
            s = scores[i]
            hit[i] &= s >= np.partition(s, n - own)[n - own] - 2 * margin[i]
        rows, columns = np.nonzero(hit)
        if not len(rows):
            return
        found = np.round(exact(rows, columns), 6)
        kth = self.scores[first + rows, own - 1]
        keep = found > kth if self.ordered else found >= kth
        self.hits.append((rows[keep] + first, columns[keep] + self.seen, found[keep]))

    def add_equal(self, row: int, score: float) -> None:
        """One query with the same score for all rows of the group."""
        n = min(self.k, len(self.ids[-1]))
        self.hits.append((np.full(n, row), np.arange(n) + self.seen, np.full(n, score)))

    def end(self) -> None:
        """Ends the group: what it found joins what was the best so far."""
        self.seen += len(self.ids[-1])
        if not self.hits:
            return
        rows, places, scores = (np.concatenate(x) for x in zip(*self.hits))
        self.hits = []
        queries = np.unique(rows)
        old = self.places[queries] >= 0
        rows = np.concatenate([rows, np.repeat(queries, old.sum(axis=1))])
        places = np.concatenate([places, self.places[queries][old]])
        scores = np.concatenate([scores, self.scores[queries][old]])
        by_id = places
        if not self.ordered:
            by_id = pc.rank(self._named(places), tiebreaker="dense").to_numpy().astype(np.int64)
            at = np.lexsort((-scores, by_id, rows))
            first = np.r_[True, (rows[at][1:] != rows[at][:-1]) | (by_id[at][1:] != by_id[at][:-1])]
            rows, places, scores, by_id = (x[at[first]] for x in (rows, places, scores, by_id))
        at = np.lexsort((by_id, -scores, rows))
        rows, places, scores = rows[at], places[at], scores[at]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < self.k
        self.scores[queries], self.places[queries] = -np.inf, -1
        self.scores[rows[keep], nth[keep]], self.places[rows[keep], nth[keep]] = scores[keep], places[keep]

    def _named(self, places: np.ndarray) -> pa.Array:
        found = pa.chunked_array(self.ids).take(pa.array(places))
        return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)

    def batches(self, qids: pa.Array, names: list[str], rows: int = 100_000):
        """The rows (qid, id, score)."""
        own, nth = np.nonzero(self.places >= 0)
        for i in range(0, len(own), rows):
            q, n = own[i : i + rows], nth[i : i + rows]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), self._named(self.places[q, n]), pa.array(self.scores[q, n])], names=names)
