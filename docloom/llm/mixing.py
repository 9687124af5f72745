"""Problem 8: one mix of several sources by target shares of tokens.

Shares are taken over the sources that have text; the size of the mix is the largest at which every
source reaches its share within its cap of repeats (or a given one). The mix is cut into blocks of one
size at every scale. Pfair scheduling gives the j-th block of a source of weight w the window
[floor((j-1)/w), ceil(j/w)) of slots; earliest deadline first fills the slots, so that after every
slot each source is within less than one block of its share. Records are laid out in a hashed order
within their source, once for each repeat, and go to the block that holds their first token.

The schedule repeats after as many slots as the weights have parts in common (100 for whole percents), so
epochs of that length are scheduled by the workers, each on its own, and the table of slots is a frame
joined on (source, block). Weights that have more than `longest_epoch` parts get epochs of that length
whose counts of blocks are rounded so that they never drift: there the deviation is less than two
blocks. Only one row per source is on the driver. Prefix sums run over two levels, hash buckets within a
source and records within a bucket, so no source is gathered in one task.

Defined results: null texts and sources and empty texts are in no mix; a source without target is
left out; a target without text is reported with a null share; a null cap means none; a cap below 1
leaves the source out.
"""

from __future__ import annotations

import base64
import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import map_lists
from docloom.session import cut

# The split pattern of the public byte-level vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}
#: Slots up to which their table is broadcast: 42 MB as a hashed relation, as measured; beyond it records are shuffled by block.
_BROADCAST_SLOTS = 200_000


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def parts(text: str, longest: int = 100_000) -> list[str]:
    """A text in parts of about `longest` characters, cut only where the split pattern begins a new piece whatever stands around: after
    a letter that no letter follows, or before white space. So the parts have as many tokens as the whole."""
    out, at, n = [], 0, len(text)
    while n - at > longest:
        to = at + longest
        while to < n and not (text[to - 1].isalpha() and not text[to].isalpha() or text[to] in " \n\t" and not text[to - 1].isspace()):
            to += 1
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def token_counts(tokenizer: str, longest: int = 100_000):
    """A rule that counts tokens."""

    def rule(ids, sources, texts):
        count = lambda t: len(_encoding(tokenizer).encode_ordinary(t))
        return [ids, sources, [sum(map(count, parts(t, longest))) for t in texts]]

    return rule


def pfair_slots(weights: list[int], blocks: list[int]) -> list[tuple[int, int, int]]:
    """(source, block, slot), all from 0. weights: integers in proportion to the target shares; blocks: how many each source needs."""
    whole, slot, waiting, ready, out = sum(weights), 0, [], [], []
    for s, (w, n) in enumerate(zip(weights, blocks)):
        if n:
            heapq.heappush(waiting, (0, s, 0))
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * whole // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * whole // weights[s], s, j + 1))
    return out


def epochs(weights: list[Fraction], longest_epoch: int) -> tuple[int, list[int] | None]:
    """(slots of an epoch, blocks of each source in it). The counts are None where they differ from epoch to epoch; such an epoch has
    slots for two blocks of the least weight, so that rounded counts never fall."""
    common = math.lcm(*(w.denominator for w in weights))
    counts = [int(w * common) for w in weights]
    whole = sum(counts) // math.gcd(*counts)
    return (whole, [c // math.gcd(*counts) for c in counts]) if whole <= longest_epoch else (max(longest_epoch, math.ceil(2 * sum(weights) / min(weights))), None)


def blocks_before(weights: list[Fraction], slots: int) -> list[int]:
    """How many blocks of each source come before slot `slots`, each less than one from its share, `slots` together."""
    whole, upto, out, last = sum(weights), Fraction(0), [], 0
    for w in weights:
        upto += w
        now = round(slots * upto / whole)
        out.append(now - last)
        last = now
    return out


def slot_table(spark, names: list[str], weights: list[Fraction], blocks: list[int], longest_epoch: int) -> DataFrame:
    """(source, block, slot) of all blocks, made by the workers an epoch at a time."""
    length, counts = epochs(weights, longest_epoch)
    most = max((-(-n * sum(weights) / w) for n, w in zip(blocks, weights)), default=0)

    def run(batches):
        for batch in batches:
            for epoch in batch.column(0).to_pylist():
                start = [epoch * c for c in counts] if counts else blocks_before(weights, epoch * length)
                own = counts or [b - a for a, b in zip(start, blocks_before(weights, (epoch + 1) * length))]
                rows = [(names[s], start[s] + j, epoch * length + slot) for s, j, slot in pfair_slots([max(1, c) for c in own], own) if start[s] + j < blocks[s]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("source", pa.string()), ("block", pa.int64()), ("slot", pa.int64())]))

    return spark.range(0, int(most) // length + 2).mapInArrow(run, "source string, block bigint, slot bigint")


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = 4096, total_tokens: int | None = None, longest_epoch: int = 50_000, rows_per_bucket: int = 50_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix (id_col, source_col, repeat_no, n_tokens, slot, start_token): one row per use of a
    record, in the order of (slot, start_token). report (source_col, target_share, max_repeats, source_tokens,
    mixed_tokens, actual_share, repeats): one row per target."""
    wanted = targets.select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("source is not null and share > 0")
    flat = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("source is not null and text is not null")
    kind = flat.schema["id"].dataType.simpleString()
    chosen = flat.join(wanted.select("source").distinct(), "source", "left_semi").select("id", "source", "text")
    sized = cut(map_lists(chosen, token_counts(tokenizer), f"id {kind}, source string, n_tokens bigint", rows=128)).where("n_tokens > 0")
    totals = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted((r["source"], Fraction(str(r["share"])), r["cap"]) for r in wanted.collect())
    present = [(s, w, c, *totals[s]) for s, w, c in rows if s in totals and (c is None or c >= 1)]
    spark, weight = docs.sparkSession, sum(w for _, w, *_ in present)
    reach = [c * t * weight / w for _, w, c, t, _ in present if c is not None]
    most = int(min(reach)) if reach else sum(t for *_, t, _ in present)
    total = most if total_tokens is None else min(total_tokens, most)
    block = max(block_tokens, 1)
    quota = [int(total * w / weight) for _, w, *_ in present]
    plan = spark.createDataFrame([(s, q, t, max(1, -(-n // rows_per_bucket))) for (s, _, _, t, n), q in zip(present, quota)], "source string, quota bigint, total bigint, buckets int")
    blocks = [-(-q // block) for q in quota]
    table = slot_table(spark, [s for s, *_ in present], [w for _, w, *_ in present], blocks, longest_epoch) if present else spark.createDataFrame([], "source string, block bigint, slot bigint")
    if sum(blocks) <= _BROADCAST_SLOTS:
        table = F.broadcast(table)

    # `plan` has one row per source
    hashed = sized.join(F.broadcast(plan), "source").withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.col("buckets")))
    order = Window.partitionBy("source", "bucket").orderBy("h", "id", "n_tokens")
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = hashed.withColumn("inside", upto(order))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    before = sums.select("source", "bucket", upto(Window.partitionBy("source").orderBy("bucket")).alias("before"))
    placed = inner.join(before, ["source", "bucket"]).withColumn("first", F.col("before") + F.col("inside"))
    # the k-th use starts at first + k * total; it is taken while the middle of the record is within the quota
    last = F.floor((F.col("quota") - F.col("first") - F.col("n_tokens") / 2) / F.col("total")).cast("int")
    used = placed.where(last >= 0).withColumn("repeat_no", F.explode(F.sequence(F.lit(0), last)))
    used = used.withColumn("start_token", F.col("first") + F.col("repeat_no") * F.col("total"))
    mixed = used.withColumn("block", F.floor(F.col("start_token") / F.lit(block)).cast("bigint")).join(table, ["source", "block"])
    mixed = mixed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "repeat_no", "n_tokens", "slot", "start_token")

    taken = mixed.groupBy(F.col(source_col).alias("source")).agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("repeat_no") + 1).alias("repeats"))
    all_tokens = taken.agg(F.sum("mixed_tokens").alias("all_tokens"))
    known = spark.createDataFrame([(s, t) for s, (t, _) in totals.items()], "source string, source_tokens bigint")
    report = (
        wanted.join(F.broadcast(known), "source", "left").join(taken, "source", "left").join(F.broadcast(all_tokens), how="left")
        .select(F.col("source").alias(source_col), F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "source_tokens", "mixed_tokens", (F.col("mixed_tokens") / F.col("all_tokens")).alias("actual_share"), "repeats")
    )
    return mixed, report
