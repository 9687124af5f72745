"""Problem 4: sentence boundaries across languages and scripts.

Unsupervised, per language, over all texts: counts of word types with and without a final period, of
the words after certain boundaries (line starts, ! ?) and of pairs (word with period, next word).
Dunning's log-likelihood ratio turns them into sentence starters, abbreviations and collocations.
A word in upper case that is common in lower case starts a sentence, too. A word that always ends in a period is an abbreviation only if what follows it is mostly no
starter; so sentence-final words do not become abbreviations in a small vocabulary. Scripts
that part sentences by spaces get starters from the first and last characters of space-separated
chunks at line starts against all chunks.

Each period is then classified with these statistics; quotes and brackets are matched, so that what
is quoted within a sentence does not end it. Lines are boundaries unless their block is wrapped.

Counting is one Arrow pass with counters per task and a pre-aggregated shuffle of word types; the
model holds only what passed the ratio tests. Its `max_entries` first types of a language and kind (by
score) go to the workers; the rest, where there is one, stays a table, and each text gets those of its
entries that it asks for, so that every entry counts. Classifying is one more pass, without a shuffle
where there is no such rest.

Defined results: null and empty texts have no units; white space is in no unit; repeated rows give
their units again.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import Both, map_lists
from docloom.session import cut

# Frequent function words that tell Latin-script languages apart.
_COMMON = {
    "en": "the of and to is that it for with as are this which every when not was only".split(),
    "de": "der die das und ist nicht den dem ein eine für von zu auf mit wird im je".split(),
    "fr": "le la les des et est un une pour dans sur que pas du au vide chaque avant".split(),
    "es": "el la los las y es un una para en con por que no se del al cada antes".split(),
    "pt": "o os as e é um uma para em com por que não se do da ao cada".split(),
    "it": "il lo gli e è un una per in con che non si del della ogni prima".split(),
    "nl": "de het een en is van voor met op niet dat die wordt elke".split(),
}
_COMMON = {k: tuple(w for x in v for w in (x, x.capitalize())) for k, v in _COMMON.items()}
_SCRIPTS = (("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("th", 0x0E00, 0x0E7F), ("ar", 0x0600, 0x06FF), ("hi", 0x0900, 0x097F), ("ru", 0x0400, 0x04FF), ("ko", 0xAC00, 0xD7A3), ("el", 0x0370, 0x03FF))
_SPACED = frozenset({"th", "lo", "km", "my"})
_UNSPACED = frozenset({"zh", "ja"})

_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0980-\u0dff\u0e31-\u0e4e])"  # with combining signs
_TYPE = re.compile(rf"{_LETTER}+(?:[.’'-]{_LETTER}+)*")
_OPEN = "([{\"'«„“‘‚¿¡「『（《"
_CLOSE = ")]}\"'»”“’」』）》"
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "（": "）", "《": "》"}
_END = re.compile(r"[.!?…؟۔।॥。！？｡]")
_BULLET = re.compile(r"[ \t]*(?:[•‣▪●◦·*+–-]|\d{1,3}[.)])[ \t]+\S")
_ELLIPSIS = re.compile(r"\.{2,}|…+")


def language(text: str, tokens: list[str] | None = None) -> str:
    """The language of a text by its script or, for Latin letters, its function words."""
    high = 0 if text.isascii() else len(text) - len(text.encode("ascii", "ignore"))
    if high > 0.04 * len(text):
        counts = Counter(text)
        letters = sum(n for c, n in counts.items() if c.isalpha()) or 1
        for name, first, last in _SCRIPTS:
            if sum(n for c, n in counts.items() if first <= ord(c) <= last) > (0.05 if name == "ja" else 0.15) * letters:
                return name
    words = Counter(text.split() if tokens is None else tokens)
    return max(_COMMON, key=lambda k: sum(words[w] for w in _COMMON[k]))


def _kind(token: str) -> str:
    """The type of a token without its outer punctuation: its lower case, # for numbers, @ for anything else."""
    bare = token.strip(_OPEN + _CLOSE + ",;:!?…؟।。！？.")
    if not bare:
        return ""
    if "." in bare and (token.rstrip(",;:.").endswith(")") or max(map(len, bare.split("."))) > 4):
        return "#" if bare[0].isdigit() else "@"  # a call or a file name, no abbreviation
    if _TYPE.fullmatch(bare) and len(bare) <= 16 and (bare[1:].islower() or bare.isupper() or len(bare) == 1 or not bare.isascii() or "." in bare):
        return bare.lower()
    return "#" if bare[0].isdigit() else "@"


def _chunk_ends(chunk: str) -> tuple[str, str]:
    """The features of a chunk in a script that parts sentences by spaces."""
    if chunk[0].isdigit():
        return "#", "#"
    if chunk[0].isascii():
        return "@", "@"
    bare = re.sub(r"[A-Za-z0-9_.()]+", "", chunk)
    return "^" + bare[:3], "$" + bare[-4:]


def _count(batches):
    """(lang, kind, a, b, n) for each batch stream: kind w: type a; l: type a in lower case; p: type a with a period before type b;
    s: type a after a certain boundary; f: chunk feature a anywhere; g: chunk feature a at a line start."""
    raw: dict[str, Counter] = defaultdict(Counter)
    pairs: dict[str, Counter] = defaultdict(Counter)
    starts: dict[str, Counter] = defaultdict(Counter)

    def rows():
        out: Counter = Counter()
        for lang, counts in raw.items():
            for token, n in counts.items():
                if (k := _kind(token)) and k not in "#@":
                    out[lang, "w", k, ""] += n
                    out[lang, "w", "", ""] += n
                    if token[:1].islower():
                        out[lang, "l", k, ""] += n
        for lang, counts in pairs.items():
            for (token, after), n in counts.items():
                k, b = _kind(token), after if after in "$," else _kind(after)
                if k and k != "@":
                    if len(after) == 2 and after[1] == "." and after[0].isupper():
                        b = "~"  # an initial says nothing
                    elif b == "," or b and b not in "#@$" and after[:1].islower():
                        b = "_"  # a word in lower case: no start
                    out[lang, "p", k, b or "_"] += n
        for lang, counts in starts.items():
            for token, n in counts.items():
                if lang in _SPACED:
                    for f in set(_chunk_ends(token)):
                        out[lang, "g", f, ""] += n
                elif (k := _kind(token)) and k not in "#@":
                    out[lang, "s", k, ""] += n
                    out[lang, "s", "", ""] += n
        for lang in _SPACED & raw.keys():
            for token, n in raw[lang].items():
                for f in set(_chunk_ends(token)):
                    out[lang, "f", f, ""] += n
        raw.clear(), pairs.clear(), starts.clear()
        keys = list(out)
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(4)] + [pa.array([out[k] for k in keys], pa.int64())], names=["lang", "kind", "a", "b", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            tokens = text.split()
            lang = language(text, tokens)
            if lang in _UNSPACED:
                continue  # their marks are not ambiguous
            raw[lang].update(tokens)
            first, two = [], []
            for line in text.split("\n"):
                tokens = line.split()
                if not tokens:
                    continue
                if lang not in _SPACED or len(tokens) > 7:  # there, short lines are headings and lists of other chunks
                    first.append(tokens[1] if len(tokens) > 1 and len(tokens[0]) == 1 and not tokens[0].isalnum() else tokens[0])
                last = len(tokens) - 1
                for i, w in enumerate(tokens):
                    if (c := w[-1]) in ".,;:!?؟।":
                        x = tokens[i + 1] if i < last else "$"
                        if c == ".":
                            if w[-2:] != "..":
                                two.append((w, x))
                        elif c in ",;:":
                            if w[-2:-1] == ".":
                                two.append((w, ","))
                        elif x != "$" and not x[0].islower():
                            first.append(x)
            starts[lang].update(first)
            pairs[lang].update(two)
        if sum(map(len, raw.values())) > 400_000:
            yield rows()
    yield rows()


def _log(p, n, k):
    """k log p + (n - k) log (1 - p), as a column."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _likelihood_ratio(n_a, n_b, n_ab, n):
    """Dunning's log-likelihood ratio of b being as frequent with a (n_ab of n_a) as it is at all (n_b of n)."""
    rest = F.greatest(F.lit(1), n - n_a)
    p, p1, p2 = n_b / n, n_ab / n_a, (n_b - n_ab) / rest
    return -2 * (_log(p, n_a, n_ab) + _log(p, n - n_a, n_b - n_ab) - _log(p1, n_a, n_ab) - _log(p2, n - n_a, n_b - n_ab))


def model_table(docs: DataFrame, text_col: str = "clean_text", max_entries: int = 50_000) -> DataFrame:
    """The model as (lang, name, a, rank), rank by score within lang and name (null where it is certain to be beyond
    `max_entries`): for each language starters, others (types seen often and hardly ever at a start), abbreviations,
    collocations and chunk features."""
    schema = "lang string, kind string, a string, b string, n bigint"
    counts = docs.select(F.col(text_col)).where(F.length(text_col) > 0).mapInArrow(_count, schema).groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    # pairs count in the sums of their first type however seldom each is; a type or a start seen once says nothing
    counts = counts.where("kind = 'p' or n > 1")
    counts = cut(counts)
    word = counts.where("kind = 'w' and a <> ''").select("lang", "a", F.col("n").alias("n_word"))
    all_words = counts.where("kind = 'w' and a = ''").select("lang", F.col("n").alias("n_all"))
    start = counts.where("kind = 's' and a <> ''").select("lang", "a", F.col("n").alias("n_start"))
    all_starts = counts.where("kind = 's' and a = ''").select("lang", F.col("n").alias("s_all"))
    typed = (
        word.join(start, ["lang", "a"], "left").join(F.broadcast(all_words), "lang").join(F.broadcast(all_starts), "lang")  # one row a language
        .withColumn("n_start", F.coalesce("n_start", F.lit(0)))
        .withColumn("ratio", F.col("n_start") / F.col("n_word"))
        .withColumn("base", F.col("s_all") / F.col("n_all"))
    )
    typed = typed.withColumn("llr", _likelihood_ratio(*map(F.col, ("n_word", "s_all", "n_start", "n_all"))))
    starters = typed.where("ratio > base and llr > 7.88 and ratio > 0.02").select("lang", "a", "llr")
    others = typed.where("n_word >= 8 and ratio < 0.004").select("lang", "a", F.col("n_word").cast("double").alias("llr"))

    low = counts.where("kind = 'l'").select("lang", "a", F.col("n").alias("n_low"))
    lowered = word.join(low, ["lang", "a"]).where("n_low > 2 and n_low > 0.05 * n_word").select("lang", "a", F.col("n_low").cast("double").alias("llr"))

    pair = counts.where("kind = 'p'").select("lang", "a", "b", "n")
    # where no word is in lower case, one that starts more often than most stands for what the case of words says elsewhere
    cased = low.select("lang").distinct()
    often = typed.where("ratio > base").select("lang", "a").join(F.broadcast(cased), "lang", "left_anti")
    begins = starters.select("lang", "a").union(lowered.select("lang", "a")).union(often).distinct()
    marked = pair.join(begins.select("lang", F.col("a").alias("b"), F.lit(1).alias("is_start")), ["lang", "b"], "left")
    ends = F.col("is_start").isNotNull() | (F.col("b") == "$")
    # a follower seen once after this word, of no known class, speaks neither for an end nor against it
    new = F.col("is_start").isNull() & (F.col("n") == 1) & ~F.col("b").isin("$", "_", "#", "~", "@")
    dotted = marked.groupBy("lang", "a").agg(F.sum("n").alias("n_dot"), F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("n_end"), F.sum(F.when(F.col("b").isin("~", "@") | new, F.col("n")).otherwise(0)).alias("n_open"), F.sum(F.when(new, 1).otherwise(0)).alias("n_new"), F.sum(F.when(F.col("b") == "#", F.col("n")).otherwise(0)).alias("n_number"))
    all_dots = dotted.groupBy("lang").agg(F.sum("n_dot").alias("d_all"))
    words = dotted.where("a <> '#'").join(word, ["lang", "a"]).join(F.broadcast(all_words), "lang").join(F.broadcast(all_dots), "lang")
    base = F.col("d_all") / F.col("n_all")
    ratio = 2 * (_log(F.lit(0.99), F.col("n_word"), F.col("n_dot")) - _log(base, F.col("n_word"), F.col("n_dot")))
    size = F.length(F.regexp_replace("a", r"\.", ""))
    inner = F.length("a") - size + 1
    score = ratio * F.exp(-size.cast("double")) * inner * F.pow(size.cast("double"), -(F.col("n_word") - F.col("n_dot")).cast("double"))
    abbreviations = (
        words.withColumn("llr", score)
        .where((F.col("n_number") > 0.6 * F.col("n_dot")) & (F.col("n_dot") > 3) | ((F.col("n_end") < 0.9 * (F.col("n_dot") - F.col("n_open"))) | (F.col("n_open") > 0.8 * F.col("n_dot"))) & ((F.col("llr") > 0.3) | (F.col("n_dot") > 0.8 * F.col("n_word")) & (F.col("n_end") < 0.5 * F.col("n_dot")) & (size < 11) & ((F.col("n_new") < 0.5 * F.col("n_dot")) | (F.col("n_dot") > 3))))
        .select("lang", "a", "llr", "n_end", "n_dot")
    )
    finals = abbreviations.where("n_end > 0.25 * n_dot").select("lang", "a", "llr")
    # significant by the ratio of likelihoods, and strong: a good part of the periods of the first type and of the second type
    collocations = (
        pair.where("b not in ('$', '@', '_', '#', '~') and n > 1").join(dotted.select("lang", "a", "n_dot"), ["lang", "a"]).join(word.withColumnsRenamed({"a": "b", "n_word": "n_b"}), ["lang", "b"]).join(F.broadcast(all_words), "lang")
        .withColumn("llr", _likelihood_ratio(*map(F.col, ("n_dot", "n_b", "n", "n_all"))))
        .where("llr > 7.88 and n / n_dot > n_b / n_all and n > 0.3 * n_dot and n > 0.1 * n_b").select("lang", F.concat_ws(" ", "a", "b").alias("a"), "llr")
    )
    at_start = counts.where("kind = 'g'").select("lang", "a", F.col("n").alias("g"))
    chunks = counts.where("kind = 'f'").join(at_start, ["lang", "a"]).where("g >= 2 and g > 0.02 * n and a not in ('#', '@')").select("lang", "a", F.col("g").cast("double").alias("llr"))
    frames = (("starters", starters), ("others", others), ("abbreviations", abbreviations), ("collocations", collocations), ("chunks", chunks), ("lowered", lowered), ("finals", finals))
    union = reduce(DataFrame.unionAll, (f.select("lang", F.lit(name).alias("name"), "a", "llr") for name, f in frames))
    # the head of a list of one language is that of the heads of its hashed parts, so no task ranks a whole list
    part = F.pmod(F.xxhash64("a"), F.lit(64))
    union = union.withColumn("head", F.row_number().over(Window.partitionBy("lang", "name", part).orderBy(F.desc("llr"), "a")) <= max_entries)
    return union.select("lang", "name", "a", F.when(F.col("head"), F.row_number().over(Window.partitionBy("lang", "name", F.when(~F.col("head"), part)).orderBy(F.desc("llr"), "a"))).alias("rank"))


def learn(docs: DataFrame, text_col: str = "clean_text") -> dict[str, dict]:
    """The whole of `model_table` as sets."""
    return _as_sets(model_table(docs, text_col))


def _as_sets(table: DataFrame) -> dict[str, dict]:
    model: dict[str, dict] = defaultdict(lambda: {n: set() for n in _NOTHING})
    for r in table.select("lang", "name", "a").collect():
        model[r["lang"]][r["name"]].add(r["a"])
    return {k: {n: frozenset(s) for n, s in v.items()} for k, v in model.items()}


_NOTHING = {"starters": frozenset(), "others": frozenset(), "abbreviations": frozenset(), "collocations": frozenset(), "chunks": frozenset(), "lowered": frozenset(), "finals": frozenset()}
_WORD_AFTER = re.compile(r"[\s]*([" + re.escape(_OPEN) + r"]*)(\S+)")


class Splitter:
    """Sentence units with a learned model."""

    def __init__(self, model: dict[str, dict]) -> None:
        self.model = model

    def units(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of each unit."""
        if not text:
            return []
        lang = (lang or "").lower()[:2] or language(text)
        out: list[tuple[int, int]] = []
        for a, b in self._blocks(text):
            self._split(text, a, b, lang, out)
        return out

    def _blocks(self, text: str):
        """Spans that hold whole units: headings, list lines, paragraphs; wrapped lines stay together."""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        blank = any(not text[a:b].strip() for a, b in lines[1:-1])
        longest = max((b - a for a, b in lines), default=0)
        wrapped = blank and longest <= 100 or longest <= 80 and len(lines) > 3
        start = end = None
        for k, (a, b) in enumerate(lines):
            line = text[a:b]
            if not line.strip():
                if start is not None:
                    yield start, end
                start = None
                continue
            if start is not None and _BULLET.match(line) and not line.lstrip()[0].isdigit():
                yield start, end
                start = None
            if start is None:
                start = a
            end = b
            after = text[lines[k + 1][0] : lines[k + 1][1]] if k + 1 < len(lines) else ""
            first = after.split(None, 1)[0] if after.strip() else ""
            joins = wrapped and first and (b - a) + 1 + len(first) > 0.8 * min(longest, 72)
            if not joins:
                yield start, end
                start = None
        if start is not None:
            yield start, end

    def _split(self, text: str, a: int, b: int, lang: str, out: list) -> None:
        cuts = self._spaced_cuts(text, a, b, lang) if lang in _SPACED else self._cuts(text, a, b, lang)
        at = a
        for c in [*cuts, b]:
            s, e = at, c
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
            at = c

    def _spaced_cuts(self, text: str, a: int, b: int, lang: str) -> list[int]:
        known = self.model.get(lang, _NOTHING)["chunks"]
        cuts, before = [], ""
        for m in re.finditer(r"\S+", text[a:b]):
            chunk = m.group()
            if before and (len(cuts) or before[-1].isalnum() or len(before) > 1):
                first, last = _chunk_ends(chunk)
                if before[-1] in "?!" and chunk[0] not in _CLOSE or first in known and last in known:
                    cuts.append(a + m.start())
            before = chunk
        return cuts

    def _cuts(self, text: str, a: int, b: int, lang: str) -> list[int]:
        model = self.model.get(lang, _NOTHING)
        cuts, begin = [], a
        for i, marks, at, quote in self._marks(text, a, b):
            if self._ends(text, begin, i, marks, at, b, quote, lang, model):
                cuts.append(at)
                begin = at
        return cuts

    def _marks(self, text: str, a: int, b: int):
        """(place, marks, end, quotation it closes) of each mark that may end a sentence."""
        closes = self._quoted(text, a, b)
        at = a
        while m := _END.search(text, at, b):
            i, at = m.start(), m.end()
            quote = next(((o, c) for o, c in closes if o < i < c), None)
            while at < b and _END.match(text, at):
                at += 1
            marks = text[i:at]
            inside = False
            while at < b and (text[at] in _CLOSE and (not quote or at <= quote[1]) or quote and text[at] in " \xa0 " and at + 1 == quote[1]):
                inside = inside or bool(quote and at == quote[1])
                at += 1
            if quote and not inside:
                at = max(i + 1, min(at, quote[1]))
                continue  # within a quotation that goes on
            yield i, marks, at, quote if inside else None

    def asked(self, text: str | None, lang: str | None = None) -> tuple[str, set[str]]:
        """The language and all entries that `units` may look up in the lists, whatever the lists hold."""
        if not text:
            return "", set()
        lang, out = (lang or "").lower()[:2] or language(text), set()
        for a, b in self._blocks(text):
            if lang in _SPACED:
                for m in re.finditer(r"\S+", text[a:b]):
                    out.update(_chunk_ends(m.group()))
                continue
            begins = [a]
            for i, _, at, _ in self._marks(text, a, b):
                if at < b and (m := _WORD_AFTER.match(text, at, b)):
                    after = _kind(m.group(2))
                    befores = {_kind(re.search(r"\S*$", text[max(begin, i - 40) : i]).group()) for begin in begins}
                    out |= {after, *befores, *(f"{x} {after}" for x in befores)}
                begins = [a, *(x for x in begins if x > i - 40), at]
        return lang, out

    def plus(self, lang: str, more: list | None) -> "Splitter":
        """This splitter with further (name, entry) pairs of a language."""
        if not more:
            return self
        own = self.model.get(lang, _NOTHING)
        return Splitter({lang: {n: Both(s, {x for k, x in more if k == n}) for n, s in own.items()}})

    @staticmethod
    def _quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
        """(open, close) of matched outer quotes and brackets of a block."""
        out, i = [], a
        while i < b:
            c = text[i]
            if c in _PAIRS:
                wanted = _PAIRS[c]
                depth, j = 1, i + 1
                while j < b and depth:
                    depth += (text[j] == c and c != wanted) - (text[j] == wanted or c == "„" and text[j] == "”")
                    j += 1
                if not depth and j - i < 400:
                    out.append((i, j - 1))
                    i = j
                    continue
            elif c == '"' or c == "'" and (i == a or not text[i - 1].isalnum()) and i + 1 < b and text[i + 1].isalnum():
                j = text.find(c, i + 1, min(b, i + 400))
                while c == "'" and 0 <= j < b - 1 and text[j + 1].isalnum():
                    j = text.find(c, j + 1, min(b, i + 400))
                if j > 0 and (i == a or text[i - 1].isspace() or text[i - 1] in "([{=:"):
                    out.append((i, j))
                    i = j + 1
                    continue
            i += 1
        return out

    def _ends(self, text: str, begin: int, i: int, marks: str, at: int, b: int, quote, lang: str, model: dict) -> bool:
        if at >= b:
            return False  # the block ends here anyway
        m = _WORD_AFTER.match(text, at, b)
        if not m:
            return False
        gap = m.start(1) > at
        opened, after = m.group(1), m.group(2)
        bare = after.strip(_CLOSE + ",;:!?…।.")
        kind = _kind(after)
        lower = bare[:1].islower() and kind != "@"
        cased = lang not in ("ar", "hi", "zh", "ja", "th", "ko")
        if lang in _UNSPACED or marks[-1] in "。！？｡":
            return self._ends_unspaced(text, begin, i, marks, at, quote, after, gap)
        starter = kind in model["starters"] or cased and bare[:1].isupper() and kind in model["lowered"]
        starter = starter and not (len(bare) == 1 and after[1:2] == "." and bare.isupper())
        if quote:
            if after[0] in "—–-,;:)" or text[at : at + 1] in ",;:":
                return False
            led = text[begin : quote[0]].rstrip().endswith((":", "："))
            whole = not text[begin : quote[0]].strip()
            if led:
                return not lower
            if text[quote[0]] in "([{":
                return whole or cased and not lower and not kind == "@" or starter
            if cased:
                return bool(gap) and not lower and (kind == "@" and not whole or starter or bare[:1].isupper() and kind not in ("@",) or bool(opened))
            return starter
        if "!" in marks or "?" in marks or "؟" in marks:
            return gap and not (lower and cased and not opened) and after[0] not in "—–,;"
        if marks[0] in "।॥۔":
            return True
        if _ELLIPSIS.fullmatch(marks):
            return gap and cased and not lower and starter and not opened
        word = re.search(r"\S*$", text[max(begin, i - 40) : i]).group()
        before = _kind(word)
        if not gap:
            # a period without a space: only between a plain word and a word that starts sentences
            return bool(re.fullmatch(r"[^\W\d_]{2,}", word.lstrip(_OPEN)) or word.endswith(")")) and starter and bare[:1].isupper() and "_" not in after and not re.search(r"[.(]", bare)
        if after[0] in "—–,;:)":
            return False
        if before == "#" or re.fullmatch(r"[\d.,]+", word):
            if lower:
                return False
            if kind == "#":
                return not after[0] in "," and lang not in ("de",)
            return starter or bool(opened) or kind == "@" or kind not in model["others"]
        single = len(word.lstrip(_OPEN)) == 1 and word[-1:].isalpha()
        if single or before in model["abbreviations"] or "." in word.strip(_OPEN) and before in model["abbreviations"]:
            if f"{before} {kind}" in model["collocations"]:
                return False
            return (starter or kind == "@" and before in model["finals"]) and not lower
        return not lower and f"{before} {kind}" not in model["collocations"]

    @staticmethod
    def _ends_unspaced(text: str, begin: int, i: int, marks: str, at: int, quote, after: str, gap: bool) -> bool:
        if marks[0] == "." and (not gap or after[0].isdigit() or after[0].islower()):
            return False
        if set(marks) == {"…"}:
            return False
        if quote:
            if text[quote[0]] in "（([":
                return not text[begin : quote[0]].strip()
            return text[begin : quote[0]].rstrip().endswith(("：", ":"))
        return True


def _with_rest(flat: DataFrame, splitter: Splitter, rest: DataFrame) -> DataFrame:
    """`flat` with `more`: the entries of `rest` that each text asks for."""

    def rule(keys, texts, langs):
        rows = []
        for key, text, lang in zip(keys, texts, langs):
            own, asked = splitter.asked(text, lang)
            rows += [(key, own, x) for x in asked]
        return [list(c) for c in zip(*rows)] if rows else [[], [], []]

    hashed = flat.withColumn("h", F.xxhash64("text", "lang"))
    asked = map_lists(hashed.select("h", "text", "lang"), rule, "h bigint, lang string, a string").distinct()
    held = asked.join(rest, ["lang", "a"]).groupBy("h").agg(F.collect_set(F.struct("name", "a")).alias("more"))
    return hashed.join(held, "h", "left")


def sentence_units(docs: DataFrame, model: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "clean_text", lang_col: str | None = None, corpus: DataFrame | None = None, max_entries: int = 50_000) -> DataFrame:
    """(id_col, start_pos, end_pos): the sentence units of `docs`; the model is learned from `corpus` (or `docs`)."""
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"))
    more = F.lit(None).cast("array<struct<name:string,a:string>>")
    if model is None:
        table = cut(model_table(docs if corpus is None else corpus, text_col, max_entries))
        splitter, rest = Splitter(_as_sets(table.where(F.col("rank") <= max_entries))), table.where(F.coalesce("rank", F.lit(max_entries + 1)) > max_entries)
        if rest.limit(1).count():
            flat, more = _with_rest(flat, splitter, rest), F.col("more")
    else:
        splitter = Splitter(model)

    def rule(ids, texts, langs, more):
        rows = []
        for key, text, lang, m in zip(ids, texts, langs, more):
            own = splitter
            if m:
                lang = (lang or "").lower()[:2] or language(text)
                own = splitter.plus(lang, [(x["name"], x["a"]) for x in m])
            rows += [(key, a, b) for a, b in own.units(text, lang)]
        return [list(c) for c in zip(*rows)] if rows else [[], [], []]

    flat = flat.select("id", "text", "lang", more.alias("more"))
    kind = flat.schema["id"].dataType.simpleString()
    return map_lists(flat, rule, f"id {kind}, start_pos int, end_pos int").withColumnRenamed("id", id_col)
