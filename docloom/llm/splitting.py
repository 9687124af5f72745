"""Problem 2: pieces of oversized texts with balanced targets.

The least number of pieces that the limit allows is computed, equal-length targets are placed, and
each target snaps to the strongest boundary near it: paragraph, line, sentence, clause, word. A
piece is a span of the text; every piece but the first starts `overlap` characters before the cut, or up
to half of the overlap earlier, where a word begins there; never inside a grapheme, if the limit allows.
When a target finds no boundary that keeps all limits, one more piece is tried; after
`extra` more pieces the cut is made at the target itself, never inside a grapheme.

Only texts above the limit leave the JVM, so the cost follows the oversized rows. There is no
shuffle. Positions and sizes are in code points.

Defined results: null and empty texts, and texts within the limit, are one piece (null text: no
span). Extra columns are kept; rows are not deduplicated.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import map_lists

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n+")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?…؟۔।][\"'”’»)\]]*\s+|[。！？][”’」』）]*\s*")
_CLAUSE = re.compile(r"[,;:،؛]\s+|[，；：、]\s*")
_WORD = re.compile(r"\s+")
_LEVELS = (_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _WORD)


def _inside_grapheme(text: str, at: int) -> bool:
    here, before = text[at], text[at - 1]
    return unicodedata.category(here) in ("Mn", "Mc", "Me") or here in "‍️" or before == "‍" or before == "\r" and here == "\n"


def _snap(text: str, target: int, low: int, high: int) -> int | None:
    """The strongest boundary in [low, high], of equal ones the nearest to `target`, then the earlier."""
    part = text[max(0, low - 8) : high + 8]
    shift = max(0, low - 8)
    for level in _LEVELS:
        ends = [e for m in level.finditer(part) if low <= (e := m.end() + shift) <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    return None


def _hard(text: str, target: int, low: int, high: int) -> int:
    for step in range(high - low + 1):
        for at in (target - step, target + step):
            if low <= at <= high and not _inside_grapheme(text, at):
                return at
    return min(max(target, low), high)


def _begin(text: str, cut: int, overlap: int) -> int:
    """Where the piece after a cut starts."""
    at = max(0, cut - overlap)
    if not overlap or not at:
        return at
    word = next((k for k in range(at, max(0, at - overlap // 2) - 1, -1) if not k or text[k - 1].isspace() and not text[k].isspace()), None)
    if word is not None:
        return word
    while at and _inside_grapheme(text, at):
        at -= 1
    return at


def spans(text: str, max_chars: int, overlap: int, extra: int = 3) -> list[tuple[int, int]]:
    """(start, end) of each piece; no piece is longer than `max_chars`, and neighbours share `overlap` characters and what `_begin` adds."""
    n, room = len(text), max_chars - overlap
    if n <= max_chars:
        return [(0, n)]
    if room <= 0:
        raise ValueError("the overlap must be less than the limit")
    least = 1 + -(-(n - max_chars) // room)
    for count in range(least, least + extra + 1):
        out, begin, at, last = [], 0, 0, count == least + extra
        share = (n - overlap) / count
        slack = max(1, int(share / 3))
        for k in range(1, count):
            target = round(overlap + k * share)
            low = max(at + 1, overlap + 1, n - (count - k) * room, target - slack)
            high = min(begin + max_chars, target + slack, n - 1)
            if low > high:
                low = max(at + 1, n - (count - k) * room)
                high = min(begin + max_chars, n - 1)
            target = min(max(target, low), high)
            to = _snap(text, target, low, high)
            if to is None:
                if not last:
                    break
                to = _hard(text, target, low, high)
            out.append((begin, to))
            begin, at = _begin(text, to, overlap), to
            if n > begin + max_chars + (count - k - 1) * room or begin + max_chars <= to or begin <= out[-1][0]:
                begin = max(0, to - overlap)  # what is left would not fit
        if len(out) == count - 1:
            return [*out, (begin, n)]
    raise AssertionError("unreachable")


def split_oversized(df: DataFrame, text_col: str, max_chars: int, overlap: int, only_oversized: bool = False, with_text: bool = True) -> DataFrame:
    """One row per piece: the columns of `df` without `text_col`, then piece_no (from 0), n_pieces, start_pos,
    end_pos and, unless `with_text` is false, piece_text. Texts within the limit stay whole in the JVM."""
    names = {c: f"_{c}" if c.lower() in ("piece_no", "n_pieces", "start_pos", "end_pos", "piece_text") else c for c in df.columns if c != text_col}
    keep = [F.col(c).alias(n) for c, n in names.items()]
    size = F.length(text_col)
    large = df.where(size > max_chars).select(*keep, F.col(text_col).alias("piece_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema.fields[:-1])
    tail = "piece_no int, n_pieces int, start_pos int, end_pos int" + ", piece_text string" * with_text

    def rule(*columns):
        *rest, texts = columns
        out = [[] for _ in range(len(rest) + 4 + with_text)]
        for i, text in enumerate(texts):
            own = spans(text, max_chars, overlap)
            for k, (a, b) in enumerate(own):
                row = [c[i] for c in rest] + [k, len(own), a, b] + [text[a:b]] * with_text
                for column, value in zip(out, row):
                    column.append(value)
        return out

    pieces = map_lists(large, rule, f"{fields}, {tail}" if fields else tail, rows=64)
    if only_oversized:
        return pieces
    whole = df.where(size.isNull() | (size <= max_chars)).select(
        *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.when(size.isNotNull(), 0).alias("start_pos"), size.alias("end_pos"),
        *([F.col(text_col).alias("piece_text")] if with_text else []),
    )
    return pieces.unionByName(whole)
