"""Problem 7: passages of held-out items inside corpus texts.

Texts are reduced to their letters and digits. Windows of the corpus texts start at every `stride`-th
character and are `min_run - stride + 1` long, so that every run of `min_run` characters holds one
whole window; windows of the items start everywhere. The CGK random walk embeds a window: at each
step the current symbol is put out and a random function of step and symbol decides whether to move
on. Windows at a small edit distance embed at a small Hamming distance, equal ones equally.
Bit sampling takes `bits` steps of the walk for each of `samples` repetitions; equal samples make a
candidate, which is then verified exactly: a run of at least `min_run` equal characters through the
window, or, with `max_edits`, an item window within that many edits.

The corpus is read once, whatever the number of items. Keys of item windows are a table; three bits of each
make a Bloom filter of a fixed size (8 MB), which all workers hold. Corpus windows that it lets through
go, with the characters around them, to an equi-join with the table on the key (by broadcast up to 500,000
keys), and are verified there, so no text is joined back and no item is on the driver. What the
filter lets through by chance (few at a million keys, all at a billion) costs rows of the join and loses nothing.

Recall is 1 for exact runs, by construction. For edits, `samples` and `bits` are chosen for a `target_recall`
(`sampling`): with that chance a window that holds all of `max_edits` random edits becomes a candidate.

Defined results: null and short texts and items are in no result; repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import map_lists
from docloom.session import cut

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_OTHER = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """Only the letters and digits of a text, after NFKC and lower-casing, without markup tags."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.lower())


class Walk:
    """CGK embeddings of windows, sampled: one 64-bit key a window and repetition."""

    def __init__(self, width: int, samples: int, bits: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.steps = width, 2 * width
        self.moves = (rng.integers(0, 1 << 31, self.steps, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.chosen = [set(rng.choice(self.steps, size=min(bits, self.steps), replace=False).tolist()) for _ in range(samples)]
        self.weights = rng.integers(0, 1 << 63, (samples, self.steps), dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def put_out(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The symbol of each step (rows) and window (columns)."""
        out = np.zeros((self.steps, len(starts)), np.uint32)
        at, end = starts.copy(), starts + np.int64(self.width)
        for step in range(self.steps):
            out[step] = np.where(at < end, codes[np.minimum(at, end - 1)], np.uint32(0))
            at += (out[step] * self.moves[step]) >> np.uint32(31)
        return out

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """`codes`: code points of all texts, followed by at least one more element; `starts`: where windows begin."""
        width = np.int64(self.width)
        out = [np.zeros(len(starts), np.uint64) for _ in self.chosen]
        at, end = starts.copy(), starts + width
        for step in range(self.steps):
            symbol = np.where(at < end, codes[np.minimum(at, end - 1)], np.uint32(0))
            for key, chosen, weights in zip(out, self.chosen, self.weights):
                if step in chosen:
                    key += (symbol.astype(np.uint64) + np.uint64(1)) * weights[step]
            at += (symbol * self.moves[step]) >> np.uint32(31)
        return out


def _codes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a gap after each, and where each text begins."""
    joined = ("\x00".join(texts) + "\x00" * (width + 1)).encode("utf-32-le", "surrogatepass")
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def sampling(width: int, max_edits: int, target_recall: float = 0.9, most_samples: int = 64, pairs: int = 400) -> tuple[int, int]:
    """(samples, bits) for windows with `max_edits` edits: the most bits, so the fewest false candidates, of which at most
    `most_samples` repetitions reach `target_recall`. The share of steps in
    which a window and its edited copy differ is measured on random windows with the walk itself."""
    if not max_edits:
        return 1, 24  # equal windows have equal keys
    if not 0 < target_recall < 1:
        raise ValueError("target_recall must lie between 0 and 1")
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(pairs):
        own = rng.integers(97, 123, width + 2 * max_edits).tolist()
        other = list(own)
        for at in sorted(rng.choice(width, min(max_edits, width), replace=False).tolist(), reverse=True):
            kind = rng.integers(3)
            other[at : at + (kind < 2)] = [] if kind == 0 else [int(rng.integers(97, 123))]
        texts += ["".join(map(chr, x)) for x in (own, other)]
    codes, starts = _codes(texts, width)
    put = Walk(width, 1, 1).put_out(codes, starts)
    same = (put[:, ::2] == put[:, 1::2]).mean(axis=0)
    for bits in range(24, 0, -1):
        missed = 1 - same**bits
        samples = next((n for n in range(1, most_samples + 1) if 1 - (missed**n).mean() >= target_recall), 0)
        if samples:
            return samples, bits
    raise ValueError(f"{max_edits} edits in {width} characters leave too little to find windows by")


def within_edits(window: str, text: str, most: int) -> bool:
    """Whether some part of `text` is at most `most` edits from the whole of `window`. One of most + 1 pieces of the window must
    stand in such a part as it is; then the columns of the edit table are kept as the bits of two integers."""
    n = len(window)
    if n and not any(window[n * k // (most + 1) : n * (k + 1) // (most + 1)] in text for k in range(most + 1)):
        return False
    if n <= most:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(window):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n  # where the column rises and falls, and its last value
    for c in text:
        same = places.get(c, 0)
        carry = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = (down | ~(carry | up)) & full, up & carry
        score += bool(rise & top) - bool(fall & top)
        if score <= most:
            return True
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = (fall | ~((same | down) | rise)) & full, rise & (same | down)
    return False


#: Item keys up to which they are broadcast, about 80 bytes each as a hashed relation, 40 MB; beyond it both sides are shuffled by key.
_BROADCAST_KEYS = 500_000
#: Bits of the mask of item keys.
_MASK = 26


def _bits(key: np.ndarray):
    """The bits of the mask of each key: three stretches of it."""
    for shift in (64 - _MASK, 64 - 45, 0):
        yield key >> np.uint64(shift) & np.uint64((1 << _MASK) - 1)


class Windows:
    """The windows of texts with their keys and the characters around them."""

    def __init__(self, min_run: int, stride: int, max_edits: int, samples: int, bits: int) -> None:
        self.min_run, self.stride, self.max_edits, self.width = min_run, stride, max_edits, min_run - stride + 1
        self.walk = Walk(self.width, samples, bits)

    def of(self, texts: list[str], step: int, mask: np.ndarray | None = None):
        """(text, key, start) of the windows at every `step`, of those that the mask lets through."""
        codes, begins = _codes(texts, self.width)
        own = [np.arange(0, max(0, len(t) - self.width + 1), step, dtype=np.int64) for t in texts]
        which = np.repeat(np.arange(len(own)), [len(o) for o in own])
        if not len(which):
            return
        offset = np.concatenate(own)
        for k, key in enumerate(self.walk.keys(codes, begins[which] + offset)):
            key = (key ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
            near = np.arange(len(key))
            if mask is not None:
                for bit in _bits(key):
                    bit = bit[near]
                    near = near[np.flatnonzero(mask[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))]
            yield from zip(which[near].tolist(), key[near].astype(np.int64).tolist(), offset[near].tolist())

    def around(self, text: str, at: int) -> tuple[str, int]:
        """A window with what verifying may need on either side, and its place therein."""
        start = max(0, at - self.stride - self.max_edits)
        return text[start : at + self.min_run + self.stride + self.max_edits], at - start

    def verified(self, text: str, p: int, item: str, q: int) -> bool:
        width = self.width
        if text[p : p + width] == item[q : q + width]:
            left, right = 0, width
            while left < p and left < q and text[p - left - 1] == item[q - left - 1]:
                left += 1
            while right < len(text) - p and right < len(item) - q and text[p + right] == item[q + right]:
                right += 1
            if left + right >= self.min_run:
                return True
        if not self.max_edits:
            return False
        starts = range(max(0, q - self.stride + 1), min(q, len(item) - self.min_run) + 1)
        return any(within_edits(item[s : s + self.min_run], text, self.max_edits) for s in starts)


def _mask(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the keys: the bits are joined by 64 on the workers, so at most 2^20 numbers come to the driver, however many keys there are."""

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            bit = np.concatenate([x for x in _bits(key)])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    found = keys.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not found.num_rows:
        return None
    mask = np.zeros(1 << (_MASK - 6), np.int64)
    mask[found["word"].to_numpy()] = found["bits"].to_numpy()
    return mask.view(np.uint8)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", min_run: int = 50, max_edits: int = 0, stride: int = 16, samples: int | None = None, bits: int | None = None, target_recall: float = 0.9) -> DataFrame:
    """(id_col, item_col): every text that holds at least `min_run` consecutive letters and digits of an item
    (or, with `max_edits`, an item window of that length within so many edits). An item may have several rows.
    `samples` and `bits` are those of `sampling` for `target_recall` unless given."""
    if samples is None or bits is None:
        own = sampling(min_run - stride + 1, max_edits, target_recall)
        samples, bits = samples or own[0], bits or own[1]
    windows = Windows(min_run, stride, max_edits, samples, bits)
    asked = items.where(F.col(item_col).isNotNull() & F.col(passage_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage"))
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = flat.schema["id"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()

    listed = cut(map_lists(asked, lambda names, texts: [names, [letters(x) for x in texts]], f"item {kinds[1]}, passage string").distinct().where(F.length("passage") >= min_run).withColumn("entry", F.xxhash64("item", "passage")))
    listed = listed.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # one file of items has many windows

    def item_rule(entries, passages):
        rows = [(entries[t], key, at) for t, key, at in windows.of(passages, 1)]
        return [list(c) for c in zip(*rows)] if rows else [[], [], []]

    keys = cut(map_lists(listed.select("entry", "passage"), item_rule, "entry bigint, key bigint, place int", rows=64))
    mask = _mask(keys)
    if mask is None:
        return docs.sparkSession.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}").toDF(id_col, item_col)

    def text_rule(ids, texts):
        texts = [letters(t) for t in texts]
        rows = [(ids[t], key, at, *windows.around(texts[t], at)) for t, key, at in windows.of(texts, stride, mask)]
        return [list(c) for c in zip(*rows)] if rows else [[], [], [], [], []]

    def verify(ids, near, at, names, passages, places):
        seen: dict = {}
        for i, t, p, name, q, r in zip(ids, near, at, names, passages, places):
            if (i, name) not in seen and windows.verified(t, p, q, r):
                seen[i, name] = True
        return [[i for i, _ in seen], [n for _, n in seen]]

    near = map_lists(flat, text_rule, f"id {kinds[0]}, key bigint, start int, near string, at int", rows=256)
    # by their count, since the planner takes the size of the items for that of their windows
    small = keys.count() <= _BROADCAST_KEYS
    own = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    met = near.join(own(keys), "key")
    if samples > 1:  # a pair of windows that meets in several samples is verified once
        met = met.dropDuplicates(["id", "start", "entry", "place", "near"])
    met = met.join(own(listed), "entry").select("id", "near", "at", "item", "passage", "place")
    return map_lists(met, verify, f"id {kinds[0]}, item {kinds[1]}", rows=8192).distinct().toDF(id_col, item_col)


def leak_report(found: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(item_col, documents): in how many texts each item was found, 0 for those that did not leak."""
    counts = found.groupBy(item_col).agg(F.count(F.lit(1)).alias("documents"))
    return items.select(item_col).distinct().join(counts, item_col, "left").select(item_col, F.coalesce("documents", F.lit(0)).alias("documents"))
