"""Problem 3: near-duplicate texts by one-permutation hashing.

Each text is the set of its different word n-grams. One permutation is divided into bins; the least
hash of a bin is its slot and empty bins borrow by optimal densification (a fixed probe sequence
for each bin, the same for all texts). Slots are grouped into bands; equal bands put texts into one
bucket. Candidates of a bucket are linear in its members: star-shaped edges from its first member to
each other one, and edges from each member to the next `reach` ones in the order of further slots, in
which like texts stand together. Buckets of up to reach + 1 members are thus compared in full. A
neighbour edge is dropped where both ends are verified links of the star's centre, since they are
joined through it. Every candidate is judged by short signatures, then verified on the full sets.

Buckets come from one range shuffle on (bucket, order), which splits a hot bucket over tasks; the few
rows at the seams are compared in a frame of their own, so that no neighbours are lost there.

Nodes are distinct n-gram sets, not rows: exact copies are one node, and a task hands on the bands of
a node once, so a group of copies that holds a third of all rows is a row a task and band.

`near_duplicate_links` and `near_duplicate_groups` need only these linear candidates. All pairs
(`near_duplicate_pairs`) are as many as the answer asks for: texts with a common link are compared,
too, which in a group of k like texts is k * k / 2 pairs, of which most are in the answer.

Recall: a pair of similarity s meets in a band with s^rows, so at 80 bands of 5 rows it meets nowhere
with (1 - s^5)^80: 0.15 % at 0.6, under 0.01 % at 0.65 and nothing measurable at 0.8. Where it meets
only in buckets of more than reach + 1 texts unlike it, it must stand near in one of their orders.
Chance meetings of unrelated texts number about texts * E[s^rows] a bucket; add a row a band (and
bands to match) for each tenfold corpus beyond 10^8 texts.

Defined results: null texts and texts with fewer words than one n-gram are in no pair and in a group
of none; repeated rows count once; a null id is an id like others; an id with two texts is in the
class of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import map_lists
from docloom.session import cut

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PROBES = 64
#: Bytes of a signature, one slot each, to judge candidates before the exact check.
_SIGNATURE = 128
#: Keys of wanted texts up to which they are broadcast: 67 MB as a hashed relation, as measured; beyond it texts are shuffled.
_BROADCAST_ROWS = 1_000_000
#: Nodes that a task remembers so as to hand on their bands once.
_SEEN = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the n-grams of lower-cased words of each text."""
    split = [[] if t is None else t.lower().split() for t in texts]
    flat = [w for own in split for w in own]
    if not flat:
        return [np.empty(0, np.uint64) for _ in split]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    grams = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for k in range(words):
        grams = (grams + hashed[k : len(hashed) - words + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    grams = _mix(grams)
    out, at = [], 0
    for own in split:
        out.append(np.unique(grams[at : at + len(own) - words + 1]) if len(own) >= words else np.empty(0, np.uint64))
        at += len(own)
    return out


def _probe_table(bins: int) -> np.ndarray:
    j, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, _PROBES + 1, dtype=np.uint64), indexing="ij")
    return ((_mix(j * np.uint64(1_000_003) + t * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def slots(grams: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a sorted set: the least hash of each bin, densified."""
    at = ((grams >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first]] = grams[first]
    filled[at[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        hit = filled[probes[empty]]
        donor = probes[empty, hit.argmax(1)]
        lost = ~hit.any(1)  # no filled bin within the table: walk to the next filled one
        if lost.any():
            full = np.flatnonzero(filled)
            donor[lost] = full[np.searchsorted(full, empty[lost]) % len(full)]
        values[empty] = values[donor]
    return values


def _sketches(words: int, bands: int, rows: int):
    bins = bands * rows
    probes = _probe_table(bins)
    weights = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
    pick = np.arange(_SIGNATURE) * bins // _SIGNATURE

    seen: set[int] = set()

    def rule(ids, hashes, texts):
        out = [[] for _ in range(6)]
        for key, h, grams in zip(ids, hashes, gram_sets(texts, words)):
            row = [key, h, None, 0, None, None]
            if len(grams):
                row[2:4] = _node(grams), len(grams)
                if row[2] not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(row[2])
                    values = slots(grams, bins, probes)
                    keys = _mix((values.reshape(bands, rows) * weights).sum(1, dtype=np.uint64) ^ salt)
                    row[4:] = keys.astype(np.int64), (values[pick] & np.uint64(255)).astype(np.uint8).tobytes()
            for column, value in zip(out, row):
                column.append(value)
        return out

    return rule


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _sets(words: int):
    seen: set[int] = set()

    def rule(texts):
        out = [[], []]
        for grams in gram_sets(texts, words):
            node = _node(grams)
            if len(grams) and node not in seen:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                out[0].append(node)
                out[1].append(grams.astype(np.int64))
        return out

    return rule


def _likeness(keep: float):
    def rule(left, right, a, b):
        if not left:
            return [[], []]
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, _SIGNATURE)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, _SIGNATURE)
        alike = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
        ok = np.flatnonzero(alike >= keep)
        return [np.array(left)[ok], np.array(right)[ok]]

    return rule


def _judged(edges: DataFrame, signatures: DataFrame, keep: float) -> DataFrame:
    """Edges (a, b) whose signatures agree in at least `keep` of the slots."""
    both = edges.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return map_lists(both, _likeness(keep), "a bigint, b bigint", rows=8192)


EDGES = "a bigint, b bigint, centre bigint, bucket bigint, place binary"


def _neighbours(reach: int):
    """Edges (a, b, centre) of rows (bucket, place, node) in order; a star's edges have no centre. Rows at the seams of a
    partition come out as (node, null, centre, bucket, place)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("centre", pa.int64()), ("bucket", pa.int64()), ("place", pa.binary())])

    def run(batches):
        tail = (np.empty(0, np.int64),) * 3  # the last rows: bucket, node, centre
        ends: list = []  # (bucket, place, node) of the last rows
        first, opening = None, 0

        def out(a, b, centre, bucket=None, place=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(centre, pa.int64()), pa.array(bucket or [None] * n, pa.int64()), pa.array(place or [None] * n, pa.binary())], schema=schema)

        for batch in batches:
            bucket, node = (np.asarray(batch.column(i)) for i in (0, 2))
            before = len(tail[0])
            bucket, node = np.concatenate([tail[0], bucket]), np.concatenate([tail[1], node])
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
            new[:before] = True
            rows = np.flatnonzero(new)
            bucket, node = bucket[rows], node[rows]
            n = len(rows)
            if n == before:
                continue
            begins = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ 1))
            centre = np.repeat(node[begins], np.diff(begins, append=n))
            if before:
                centre[bucket == tail[0][-1]] = tail[2][-1]
                centre[:before] = tail[2]
            leaf = np.flatnonzero(centre != node)
            leaf = leaf[leaf >= before]
            yield out(centre[leaf], node[leaf], [None] * len(leaf))
            for k in range(1, reach + 1):
                late = np.arange(max(k, before), n)
                late = late[bucket[late] == bucket[late - k]]
                late = late[(node[late - k] != centre[late]) & (node[late] != centre[late])]
                if len(late):
                    yield out(node[late - k], node[late], centre[late])
            if first is None:
                first = bucket[0]
            if opening <= reach:
                start = np.flatnonzero(bucket[before:] == first)[: reach + 1 - opening] + before
                opening += len(start) if len(start) and bucket[-1] == first else reach + 1
                place = batch.column(1).take(pa.array(rows[start] - before)).to_pylist()
                yield out(node[start], [None] * len(start), centre[start], bucket[start].tolist(), place)
            keep = np.arange(max(0, n - reach), n)
            fresh = keep[keep >= before]
            ends = [*ends, *zip(fresh.tolist(), batch.column(1).take(pa.array(rows[fresh] - before)).to_pylist(), bucket[fresh].tolist(), node[fresh].tolist(), centre[fresh].tolist())][-reach:]
            tail = bucket[keep], node[keep], centre[keep]
        if ends:
            ends = [e for e in ends if e[2] == ends[-1][2]]
            yield out([e[3] for e in ends], [None] * len(ends), [e[4] for e in ends], [e[2] for e in ends], [e[1] for e in ends])

    return run


def _edges(base: DataFrame, reach: int) -> DataFrame:
    """Distinct (a, b, centre), a < b: stars (without centre) and neighbours in the order of further slots, bucket by bucket."""
    place = F.expr(f"substring(signature, 1 + (pos * 37) % {_SIGNATURE - 7}, 8)")
    rows = base.where("bands is not null").select("node", "signature", F.posexplode("bands").alias("pos", "bucket")).select("bucket", place.alias("place"), "node")
    order = ("bucket", "place", "node")
    return joined_seams(cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(reach), EDGES)), reach)


def joined_seams(found: DataFrame, reach: int) -> DataFrame:
    """The edges of all partitions and those over their seams, of at most 2 * reach + 1 rows a partition."""
    seam = Window.partitionBy("bucket").orderBy("place", "a")
    rest = found.where("bucket is not null").select("bucket", "place", "a", "centre").distinct().withColumn("head", F.first("centre").over(seam))
    nexts = rest.withColumn("after", F.array(*(F.lead("a", k).over(seam) for k in range(1, reach + 1)))).withColumn("b", F.explode("after"))
    none = F.lit(None).cast("bigint")
    heads = rest.select("head", F.explode(F.array("centre", "a")).alias("b"), none)
    nexts = nexts.where("b is not null and a <> head").select("a", "b", "head")
    every = found.where("bucket is null").select("a", "b", "centre").union(heads).union(nexts)
    return every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "centre").distinct()


def _few(keys: DataFrame) -> DataFrame:
    """Keys for a semi-join: broadcast only where their count allows."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= _BROADCAST_ROWS else keys


class Collection:
    """The classes, candidates and links of one collection."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold: float, words: int, bands: int, rows: int, reach: int) -> None:
        self.threshold, self.words = threshold, words
        self.texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
        flat = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
        kind = flat.schema["id"].dataType.simpleString()
        self.base = cut(map_lists(flat, _sketches(words, bands, rows), f"id {kind}, key bigint, node bigint, size int, bands array<bigint>, signature binary", rows=128))
        self.members = self.base.select("id", "node", "size").distinct()
        self.signatures = self.base.where("signature is not null").select("node", "signature").distinct()
        edges = cut(_edges(self.base, reach))
        stars = self.judged(edges.where("centre is null").select("a", "b"))
        nexts = self.judged(edges.where("centre is not null").select("a", "b").distinct())
        self.candidates = cut(stars.withColumn("star", F.lit(True)).union(nexts.withColumn("star", F.lit(False))).groupBy("a", "b").agg(F.max("star").alias("star")))
        self.sets = self._sets()
        first = cut(self.verified(self.candidates.where("star").select("a", "b")))
        linked = first.select(F.col("a").alias("x"), F.col("b").alias("centre")).union(first.select("b", "a"))
        # an edge both of whose ends are links of a centre joins what is joined
        through = edges.where("centre is not null").join(linked.withColumnRenamed("x", "a"), ["a", "centre"], "left_semi").join(linked.withColumnRenamed("x", "b"), ["b", "centre"], "left_semi")
        rest = self.candidates.where("not star").select("a", "b").join(through.select("a", "b").distinct(), ["a", "b"], "left_anti")
        self.links = cut(first.union(self.verified(rest)))

    def judged(self, edges: DataFrame) -> DataFrame:
        """Edges that are similar enough by their signatures to be verified: five deviations below the threshold."""
        return _judged(edges, self.signatures, max(0.05, self.threshold - 0.20))

    def _sets(self) -> DataFrame:
        """(node, grams) of the nodes of all candidates."""
        wanted = self.candidates.select(F.col("a").alias("node")).union(self.candidates.select(F.col("b").alias("node"))).distinct()
        keys = self.base.where("bands is not null").groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi").select("key").distinct()
        texts = self.texts.join(_few(keys), "key", "left_semi").select("text")
        return cut(map_lists(texts, _sets(self.words), "node bigint, grams array<bigint>", rows=128).dropDuplicates(["node"]))

    def verified(self, edges: DataFrame) -> DataFrame:
        """(a, b, similarity) of the edges at or above the threshold, by their whole sets."""
        edges = cut(edges)
        sets = self.sets.join(_few(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()), "node", "left_semi")
        joined = edges.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
        both = F.size(F.array_intersect("ga", "gb"))
        return (
            joined.select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("sum"))
            .select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
            .where(F.col("similarity") >= self.threshold)
        )

    def pairs(self) -> DataFrame:
        """(a, b, similarity): the links and all further pairs that have a common link."""
        ends = self.links.select(F.col("a").alias("mid"), F.col("b").alias("x")).union(self.links.select("b", "a"))
        two = ends.join(ends.withColumnRenamed("x", "y"), "mid").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = two.join(self.links, ["a", "b"], "left_anti")
        return self.links.union(self.verified(self.judged(new)))


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text", threshold: float = 0.8, words: int = 5, bands: int = 80, rows: int = 5, reach: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, links). members (id, node, size): every distinct id with the class of its n-gram set (null for
    none); links (a, b, similarity), a < b: verified pairs of different classes through which all classes of a group
    are joined. Their number is linear in the texts."""
    own = Collection(docs, id_col, text_col, threshold, words, bands, rows, reach)
    return own.members, own.links


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text", threshold: float = 0.8, words: int = 5, bands: int = 80, rows: int = 5, reach: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) as `near_duplicate_links`, but with all pairs of different classes at or above the threshold."""
    own = Collection(docs, id_col, text_col, threshold, words, bands, rows, reach)
    return own.members, own.pairs()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating large and small stars to the fixed
    point (RuntimeError if `rounds` do not reach it; they number about the square of the logarithm of the nodes).
    The edges are written to the checkpoint folder each round; nothing is gathered."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: strictly larger neighbours go to the least of the neighbourhood; small: smaller ones and the node itself
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select("a", "m")
        joined = near.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now, seen = cut(edges.select("a", "b").where("a <> b").distinct()), None
    for _ in range(rounds):
        after = cut(star(star(now, True), False))
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"{rounds} rounds did not join the components")
    return now.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text", threshold: float = 0.8, words: int = 5, bands: int = 80, rows: int = 5, reach: int = 8) -> DataFrame:
    """(id_col, class_id, group_id): one row per distinct id and class. class_id names the n-gram set, group_id the
    least class that can be reached over links at or above the threshold; both are null for texts without n-grams."""
    members, links = near_duplicate_links(docs, id_col, text_col, threshold, words, bands, rows, reach)
    return members.join(components(links), "node", "left").select(F.col("id").alias(id_col), F.col("node").alias("class_id"), F.coalesce("root", "node").alias("group_id"))


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different ids, copies of one class included."""
    known = members.where("node is not null")
    copies = known.alias("x").join(known.alias("y"), "node").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    left = pairs.join(known.select(F.col("node").alias("a"), F.col("id").alias("ida")), "a")
    across = left.join(known.select(F.col("node").alias("b"), F.col("id").alias("idb")), "b").where("ida <> idb")
    return across.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).union(copies).distinct()
