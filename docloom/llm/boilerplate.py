"""Problem 1: page furniture mixed with the main body.

Blocks are the lines of a page. The first pass classifies them by link density, length and stop-word
density: blocks that are mostly links and menus of short parts between separators are furniture; long
blocks with function words, sentences, list items and code are main body; a line that recurs further down
as a heading is an entry of the contents list. Short blocks that nothing decides are left open. The second
pass gives each open block the label of its nearest decided neighbours; a heading-like line joins the main
body that follows it even over furniture.

Link density comes from the raw HTML where it is kept: each block's linked characters over all its
characters, navigation elements counting as linked. Pages join their marked blocks by file path. Where
no HTML is kept, or it marks nothing, link density is estimated from the words of a block: `link_model` counts words, pairs
of words and openings of blocks in linked and in other blocks of pages with HTML, and a block's log-odds
decide it where they are clear. The counts come from a bounded sample of labelled pages
(`sample_pages`). Phrases that furniture is known by (cookies, rights, bylines) break ties only: they
label a block that neither density nor estimate decides, or one of a collection without any HTML.

Defined results: null and empty texts have no lines; empty lines are never named; repeated rows count once; a
path with several pages counts the one of the greatest hash; rows of one id are judged each by its own text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import free_name, map_lists
from docloom.session import cut

# Frequent function words of ten languages; for scripts without spaces, characters and endings.
_STOP = frozenset(
    (
        "a an and are as at be before but by can does each every for from has have if in into is it its may must no not of off on once one only or so than that the their then there this to under up was when which while who will with you your "
        "der die das den dem des ein eine einen und oder ist sind nicht auf für von zu mit im in je bevor wird werden um seit pro zum zur es er sie "
        "le la les un une des du de et est sont ne pas pour dans sur que qui par avant chaque au aux se il elle depuis si en "
        "el los las uno una unos y o es son no para por con del al antes de cada se lo su sin desde si en que "
        "и в на не с по для из до от или если когда пока один при это как что к "
        "من في على إلى عن أن لا إذا منذ قبل ما كل و أو هل متى "
        "का की के को से में है हैं नहीं तो और पर यदि एक कब क्या लिए ने"
    ).split()
)
_STOP_SIGNS = re.compile("[的了在是把将个并会和与为]|[はがをにでとのもへ]|(?:です|ます|ない)|(?:และ|ที่|ใน|ของ|จะ|ไม่|เป็น|ก่อน|ให้|การ)")

# What furniture says anywhere in a line, in lower case, in ten languages.
_CUE_WORDS = (
    "cookie", "куки", "クッキー", "كوكيز", "ملفات تعريف", "कुकी", "คุกกี้",
    "©", "copyright", "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos", "все права защищены", "保留所有权利", "無断転載", "著作権", "جميع الحقوق", "สงวนลิขสิทธิ์",
    "without warranty", "is a trademark of", "are trademarks of", "may change without notice", "ohne gewähr", "sans garantie", "sin garantía",
    "was this page helpful", "was this helpful", "hilfreich?", "vous a-t-elle aidé", "ha servido esta", "была полезна", "有帮助吗", "役に立ちましたか",
    "seite teilen", "share this page", "partager cette page", "compartir esta página", "поделиться страницей", "分享本页", "このページを共有",
    "newsletter", "in this article", "report a problem", "edit this page",
)
# What furniture begins with, or is as a whole, in lower case.
_CUE_START = re.compile(
    r"(?:skip to|zum inhalt|aller au|saltar al|ir al|перейти к|本文へ|跳到|跳转|跳至|تخط|انتقل إلى|ข้ามไป)"
    r"|(?:sign in|log ?in|anmelden|se connecter|connexion|iniciar sesión|войти|вход|登录|登錄|ログイン|تسجيل الدخول|เข้าสู่ระบบ|menu|menü|menú|меню|菜单|メニュー|القائمة|toggle navigation|sign up)$"
    r"|(?:english|deutsch|français|español|русский|日本語|中文|العربية|हिन्दी|ไทย)(?:[\s|·,/]+(?:english|deutsch|français|español|русский|日本語|中文|简体中文|العربية|हिन्दी|ไทย|italiano|português))+$"
    r"|(?:search|rechercher|buscar|поиск|suche|搜索|検索|بحث|ค้นหา).{0,40}$|[\w ]{2,30}(?: durchsuchen|を検索|内検索)$"
    r"|(?:share|teilen|partager|compartir|поделиться)\b.{0,60}$"
    r"|(?:rate this|did this help)"
    r"|.{0,40}(?:terms of (?:use|service)|privacy|imprint|impressum|datenschutz|nutzungsbedingungen|mentions légales|confidentialité|aviso legal|privacidad|условия|конфиденциальность|使用条款|隐私|利用規約|個人情報|legal notice|disclaimer).{0,40}$"
    r"|(?:written|reviewed|edited|posted|published|verfasst|geschrieben|rédigé|écrit|escrito|redactado|автор|написано|บทความโดย)\b.{0,60}$|(?:作者|執筆|编辑|文)[：:].{0,30}$"
    r"|(?:last (?:built|updated|modified|edited)|built on|updated on|zuletzt geändert|stand:|dernière mise à jour|última actualización|обновлено|最后更新|最終更新|آخر تحديث|generated (?:by|on))"
    r"|(?:tags?|labels?|filed under|categories|category|topics|keywords|schlagwörter|mots-clés|etiquetas|теги|метки|标签|タグ)(?:\s*[:：–—-]\s*\S|\s+\S+(?:,\s*\S+)+$|\s+\S+$)"
    r"|(?:related|you may also like|read next|see next|next up|next|previous|prev|up next|more like this|ähnliche|weiter|zurück|suivant|précédent|siguiente|anterior|далее|назад|相关|下一页|上一页|次へ|前へ)\s*(?:[:：→←»«–—-]|$)|[←→‹›]\s*\S.{0,120}$|[«»]\s+[^«»]{2,80}$"
    r"|(?:advert(?:isement|ising)?|sponsored|sponsor|webinar|anzeige|werbung|publicité|publicidad|anuncio|реклама|广告|広告|ad)\s*(?:[:：–—-]|$)"
    r"|(?:subscribe|abonnieren|abonnez|suscríbase|suscribirse|подпис|订阅|購読)"
    r"|(?:page views|views|seitenaufrufe|vues|visitas|просмотры|浏览|閲覧)\s*[:：]?\s*\d+|\d+ (?:readers|views|people|leser|lecteurs|lectores)\b"
    r"|comment(?:s|aire|ario)? (?:by|von|de|par)\b|\d+ comments?$|\S{2,30} wrote:|@?\S{2,24} [·•|-] \d+ \w+ ago\b"
    r"|(?:back to top|nach oben|haut de page|volver arriba|наверх|返回顶部|トップへ|listen to this|print this|view source|improve this page|on this page|table of contents|contents|inhaltsverzeichnis|sommaire|índice de contenidos|содержание|目录|目次)\b.{0,30}$"
    r"|[\w &'-]{2,30} documentation, release [\d.]+$"
    r"|.{2,24}(?:文档组|文書班|编写组|編集部)$"
)


def says_furniture(line: str) -> bool:
    line = line.lower()
    return any(w in line for w in _CUE_WORDS) or bool(_CUE_START.match(line))


_RIGHTS = re.compile(r"(?:©|copyright\b)", re.I)


def _says_much(line: str) -> bool:
    """Whether a long line is furniture: it begins with a claim of rights or has two of the cues that a paragraph may have one of."""
    low = line.lower()
    return bool(_RIGHTS.match(low)) or sum(w in low for w in _CUE_WORDS) > 1 + ("©" in low and "copyright" in low)


_PARTS = re.compile(r"\s*[|·•›]\s*|\s+[»>/‹«]\s+")
_CODE = re.compile(r"^\s*(?:[$#>@{}\[\]<\\|`]|\w+\s*(?:=|\+=|<-|:=)\s|(?:for|if|while|def|class|return|import|from|select|let|const|var)\b.*[:;{(\[]|\w[\w.<>, ]*\s\w+\s*=)|[;{}]\s*$|^\s*[\w.]+\(.*\)\s*$|^\s*\d[\d.,\w/_-]*,[\w.,/_-]+$|^\s*\{?\|")
_ROW = re.compile(r"\{?\|.*\|$")  # a row of a table
_ITEM = re.compile(r"^\s*(?:[•‣▪●*+–:;#-]|\d{1,3}[.)])\s*\S")
_SENTENCE_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]）」]*\s*$")
_NAME_LIKE = re.compile(r"[A-Za-z]+_[A-Za-z_]+|[A-Za-z]\.[a-z]+\(\)|[A-Za-z][a-z]+[A-Z][a-z]+")
_HEAD_MARK = re.compile(r"^\s*(?:#{1,6}\s|={2,6}\s*\S.*=\s*$|\\(?:sub)*section\*?\{|<h[1-6]\b)", re.I)
#: What markup puts around a heading; a contents entry is the heading without it.
_AROUND = re.compile(r"^[#=*\s]+|[=*\s]+$|<[^<>]+>|\\\w+\*?\{|\{#[\w-]+\}|[}`]")
_SECTION = frozenset("example examples notes note parameters returns return see\xa0also see syntax usage arguments raises options".split()) | {"see also"}

GOOD, BAD, OPEN = 1, -1, 0


def line_key(text: str) -> int:
    return xxhash.xxh64_intdigest("".join(text.lower().split()).encode("utf-8", "surrogatepass")) >> 1


_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([A-Za-z][\w:-]*)[^<>]*>|\n", re.S | re.I)
_NAVIGATION = frozenset(("nav", "footer", "aside", "header"))
_BLOCK_TAGS = _NAVIGATION | frozenset("div p li ul ol dl dt dd tr table section article main form h1 h2 h3 h4 h5 h6 br".split())
_OWN_TEXT = frozenset(("main", "article"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def link_blocks(page: str | None) -> list[int]:
    """Hashes of the blocks of an HTML page that are navigation or of which most characters are links, of any length.

    A block ends at a line break or at a tag of a block. Navigation is what nav, footer, aside and header hold over
    any number of lines, up to their end tag; one that is never closed holds only the line it opens. A heading in a
    header, and a header of the page's own article, are none."""
    if not page:
        return []
    out: dict[int, None] = {}
    start = m.end() if (m := re.search(r"<body\b[^>]*>", page, re.I)) else 0
    open_: list[tuple[str, int]] = []  # navigation elements, by number
    closed: set[int] = set()
    blocks: list[tuple[str, int, int, tuple[int, ...], bool, bool]] = []
    text: list[str] = []
    size = linked = links = heads = own = number = 0
    opened_here: set[int] = set()

    def flush() -> None:
        nonlocal size, linked
        if size:
            blocks.append(("".join(text), size, linked, tuple(k for _, k in open_), bool(opened_here & {k for _, k in open_}), bool(heads) and all(n == "header" for n, _ in open_)))
        text.clear()
        size = linked = 0

    at = start
    for m in _TAG.finditer(page, start):
        piece = html.unescape(page[at : m.start()])
        at = m.end()
        if piece:
            n = len("".join(piece.split()))
            text.append(piece)
            size += n
            linked += n * bool(links)
        name = (m.group(3) or "").lower()
        if m.group() == "\n":
            flush()
            opened_here.clear()
        elif not name:
            continue
        elif name == "a":
            links = 0 if m.group(2) else 1
        elif name in _BLOCK_TAGS:
            flush()
            if name in _OWN_TEXT:
                own = max(0, own + (-1 if m.group(2) else 1))
            elif name in _HEADINGS:
                heads = 0 if m.group(2) else 1
            elif name in _NAVIGATION and not m.group(2):
                number += 1
                if not (name == "header" and own):
                    open_.append((name, number))
                    opened_here.add(number)
            elif name in _NAVIGATION:
                while any(n == name for n, _ in open_):
                    n, k = open_.pop()
                    if n == name:
                        closed.add(k)
                        break
        else:
            text.append(" ")
    text.append(html.unescape(page[at:]))
    size = len("".join("".join(text).split()))
    flush()
    for content, size, linked, inside, here, heading in blocks:
        if linked > 0.5 * size or not heading and (here or any(k in closed for k in inside)):
            out[line_key(content)] = None
    return list(out)


def stop_density(line: str) -> float:
    words = line.lower().split()
    if not words:
        return 0.0
    if line.isascii():
        return sum(w.strip(",.;:!?()\"'") in _STOP for w in words) / len(words)
    signs = len(_STOP_SIGNS.findall(line))
    return max(sum(w.strip(",.;:!?()\"'«»„“”¿¡، ؟") in _STOP for w in words) / len(words), 4 * signs / max(len(line), 1))


_EDGES = ".,;:!?()[]\"'«»„“”¿¡،؟…"
_RUN = re.compile(r"[0-9]+")
_CODE_WORD = re.compile(r"[\w@{}]*(?:[_@{}()/#]|[a-z][A-Z]|\w\.\w|[^\W\d]\d)[^\s]*")


def _unspaced(c: str) -> bool:
    return "\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3"


_FORMS: dict[str, tuple[str, ...]] = {}


def _forms(word: str) -> tuple[str, ...]:
    """A word in lower case, digits as #, an identifier as @, scripts without spaces in pairs of characters; remembered, since words recur."""
    own = _FORMS.get(word)
    if own is None:
        bare = word.strip(_EDGES)
        if bare and not bare.isascii() and any(map(_unspaced, bare)):
            own = tuple(bare[i : i + 2] for i in range(max(1, len(bare) - 1)))
        else:
            own = ("@",) if _CODE_WORD.fullmatch(bare) else (_RUN.sub("#", (bare or word).lower()),)
        if len(_FORMS) >= 200_000:
            _FORMS.clear()
        _FORMS[word] = own
    return own


def _openings(words: list[str]) -> list[str]:
    """The openings of a block of (raw) words: up to four words, and a first one with a mark, such as "related:" or an arrow."""
    if not words:
        return []
    start = [f for w in words[:4] for f in _forms(w)][:4]
    out = ["^" + " ".join(start[:k]) for k in range(2, len(start) + 1)]
    head = words[0].lower()
    if len(head) < 24 and not head[-1].isalnum() and not _RUN.search(head):
        out.append("^^" + head)
    return out


def _word_features(words: list[str]) -> set[str]:
    forms = [f for w in words for f in _forms(w)]
    return {*forms, *map(" ".join, zip(forms, forms[1:]))}


def block_features(line: str) -> tuple[set[str], list[str]]:
    """The words with their pairs, and the openings of a block."""
    words = line.split()
    return _word_features(words), _openings(words)


class LinkModel:
    """Estimated link density of blocks: log-odds of being linked, by their opening and, for blocks shorter than a paragraph, all words."""

    def __init__(self, weights: dict[str, float], sure: float = 3.0, body: float = -9.0, paragraph: int = 200) -> None:
        self.weights, self.sure, self.body, self.paragraph = weights, sure, body, paragraph

    def linked(self, line: str) -> int:
        """1 for a block that is linked by all odds, -1 for one that is not, 0 for neither."""
        long = len(line) >= self.paragraph
        words = line.split(None, 4) if long else line.split()
        if any(self.weights.get(o, 0.0) > self.sure for o in _openings(words)):
            return 1
        if long:
            return 0
        known = [self.weights[w] for w in _word_features(words) if w in self.weights]
        odds = sum(known) / math.sqrt(len(known)) if known else 0.0
        return 1 if odds > self.sure else -1 if odds < self.body else 0


def labelled_blocks(text: str, links: list[int]) -> set[tuple[str, bool]]:
    """The different blocks of a page and whether each is linked. A linked block whose words recur further down, before body,
    is an entry of the contents list, and what recurs is the heading."""
    marked = set(links)
    bare = [b for x in text.split("\n") if (b := " ".join(x.split()))]
    hit = [line_key(b) in marked for b in bare]
    last, times = {b: j for j, b in enumerate(bare)}, Counter(bare)
    return {(b, h and not (times[b] > 1 and last[b] == j and j + 1 < len(bare) and not hit[j + 1])) for j, (b, h) in enumerate(zip(bare, hit))}


def _label_counts(batches):
    """(feature, linked, plain) of the blocks of pages, the feature "" for all blocks, counted in the task."""
    linked, plain = Counter(), Counter()

    def rows():
        keys = list(linked.keys() | plain.keys())
        out = [pa.array(keys, pa.string()), pa.array([linked[k] for k in keys], pa.int64()), pa.array([plain[k] for k in keys], pa.int64())]
        linked.clear(), plain.clear()
        return pa.RecordBatch.from_arrays(out, names=["feature", "linked", "plain"])

    for batch in batches:
        for text, links in zip(*(c.to_pylist() for c in batch.columns)):
            for line, is_linked in labelled_blocks(text, links):
                words, openings = block_features(line)
                (linked if is_linked else plain).update([*words, *openings, ""])
        if len(linked) + len(plain) > 500_000:
            yield rows()
    yield rows()


def link_model(sample: DataFrame, least: int = 3, strong: float = 2.0) -> LinkModel | None:
    """The model of a bounded sample (text, links) of pages and the hashes of their linked blocks; features seen `least`
    times or more and of log-odds of `strong` or more count. None without linked blocks."""
    counts = sample.select("text", "links").mapInArrow(_label_counts, "feature string, linked bigint, plain bigint").groupBy("feature").agg(F.sum("linked").alias("linked"), F.sum("plain").alias("plain"))
    counts = cut(counts)
    all_ = counts.where("feature = ''").first()
    if not all_ or not all_["linked"] or not all_["plain"]:
        return None
    odds = F.log((F.col("linked") + 0.5) / (all_["linked"] + 1)) - F.log((F.col("plain") + 0.5) / (all_["plain"] + 1))
    # pairs and openings speak for links only, single words on both sides
    known = counts.where((F.col("linked") + F.col("plain") >= least) & (F.col("feature") != "")).withColumn("odds", F.round(odds, 3))
    kept = known.where(F.col("odds").between(strong, 99) | (F.col("odds") <= -strong) & ~F.col("feature").contains(" ") & ~F.col("feature").startswith("^"))
    return LinkModel({r["feature"]: r["odds"] for r in kept.select("feature", "odds").collect()})


def _dense(bare: str) -> int:
    """What length and stop-word density say of a block that is not linked."""
    if _HEAD_MARK.match(bare):
        return GOOD
    wide = len(bare) * (2 if any("\u3040" <= c <= "\u9fff" for c in bare[:40]) else 1)
    if wide >= 52 and (stop_density(bare) >= 0.15 or wide >= 60 and ". " in bare):
        return GOOD
    if wide >= 90 or _SENTENCE_END.search(bare) and wide >= 25 and (stop_density(bare) > 0.08 or wide >= 50):
        return GOOD
    return GOOD if _ITEM.match(bare) and wide > 12 or _CODE.search(bare) else OPEN


def _is_menu(bare: str) -> bool:
    """Short parts between separators: a menu or a breadcrumb."""
    if _SENTENCE_END.search(bare) or not any(x in bare for x in ("|", "·", "»", "›", " / ", " > ")):
        return False
    parts = [p for p in _PARTS.split(bare) if p]
    return len(parts) >= 3 and not _CODE.search(bare) and max(map(len, parts)) < 40


def _says(bare: str) -> bool:
    return not _ITEM.match(bare) and (says_furniture(bare) if len(bare) < 220 else _says_much(bare))


def _first_pass(bare: str, linked: bool, model: LinkModel | None) -> int:
    if linked or _is_menu(bare):
        return BAD
    if model is None:
        return BAD if _says(bare) else _dense(bare)
    odds = 0 if _ROW.match(bare) else model.linked(bare)
    if odds:
        return BAD if odds > 0 else _dense(bare)
    return BAD if _says(bare) else _dense(bare)  # a tie


def furniture_lines(text: str | None, links: list[int] | None = None, model: LinkModel | None = None) -> list[int]:
    """The numbers (from 1) of the non-empty lines that are not main body; linear in the lines."""
    if not text:
        return []
    linked = set(links or ())
    bare = [" ".join(x.split()) for x in text.split("\n")]
    rows = [i for i, b in enumerate(bare) if b]
    keys = ["".join(_AROUND.sub("", bare[i]).lower().split()) for i in rows]
    first, last, times = {}, {}, Counter(keys)
    for j, k in enumerate(keys):
        first.setdefault(k, j)
        last[k] = j
    n, labels = len(rows), []
    for j, (i, key) in enumerate(zip(rows, keys)):
        # hashes are needed only where there are links; the heading that a contents entry points to has its words
        marked = bool(linked) and line_key(bare[i]) in linked and (last[key] != j or times[key] == 1)
        label = _first_pass(bare[i], marked, None if linked else model)  # no estimate where there is a measure
        if label == OPEN and last[key] > j and len(bare[i]) < 120:
            label = BAD  # an entry of the contents list
        elif label == OPEN and first[key] < j:
            label = GOOD  # the heading it points to
        if label == OPEN and labels and labels[-1] == GOOD and rows[j - 1] == i - 1 and len(bare[i - 1]) >= 40 and not _SENTENCE_END.search(bare[i - 1]) and not _ITEM.match(bare[i - 1]) and _SENTENCE_END.search(bare[i]):
            label = GOOD  # the end of a wrapped sentence
        labels.append(label)
    before, after = [-1] * n, [n] * n  # the nearest decided block on either side
    for j in range(1, n):
        before[j] = j - 1 if labels[j - 1] else before[j - 1]
    for j in range(n - 2, -1, -1):
        after[j] = j + 1 if labels[j + 1] else after[j + 1]
    out = []
    for j, label in enumerate(labels):
        if label == OPEN:
            left = labels[before[j]] if before[j] >= 0 else BAD
            right = labels[after[j]] if after[j] < n else BAD
            if left == GOOD and right == BAD and GOOD not in labels[after[j] : after[j] + 4]:
                label = BAD  # nothing follows that it could head
            elif left == right:
                label = left
            else:
                label = left if j - before[j] < after[j] - j else right
            if label == GOOD and left != right and not _heading_like(bare[rows[j]]):
                label = BAD
            elif label == BAD and _heading_like(bare[rows[j]]):
                # a heading belongs to the body after it, over furniture between them
                follows = next((k for k in range(j + 1, min(n, j + 5)) if labels[k] == GOOD), None)
                if follows is not None and all(labels[k] == BAD or _heading_like(bare[rows[k]]) for k in range(j + 1, follows)):
                    label = GOOD
        if label == BAD:
            out.append(rows[j] + 1)
    return out


def _heading_like(line: str) -> bool:
    return len(line) < 120 and bool(_NAME_LIKE.search(line) or line.lower() in _SECTION or len(line.split()) >= 3 and not re.search(r"\(\d+\)$", line))


def _linked(docs: DataFrame, pages: DataFrame | None, text_col: str, path_col: str, html_col: str, sample_pages: int) -> tuple[DataFrame, LinkModel | None, str]:
    """`docs` with a further column of the hashes of the linked blocks of each page, the model, and the column's name."""
    links = free_name(docs, "links")
    if pages is None or path_col not in docs.columns:
        return docs.withColumn(links, F.lit(None).cast("array<bigint>")), None, links
    blocks = map_lists(pages.where(F.col(path_col).isNotNull()).select(path_col, html_col), lambda p, h: [p, [x and xxhash.xxh64_intdigest(x) >> 1 for x in h], [link_blocks(x) for x in h]], "path string, h bigint, links array<bigint>", rows=128)
    path, key = free_name(docs, "path"), free_name(docs, "key")
    blocks = cut(blocks.groupBy(F.col("path").alias(path)).agg(F.max_by("links", "h").alias(links)))
    # null paths join nothing; they are spread over the partitions by their text
    own = docs.withColumn(path, F.coalesce(path_col, F.concat(F.lit("\x00"), F.xxhash64(text_col).cast("string"))))
    both = own.join(blocks, path, "left").select(*docs.columns, links)
    wanted = docs.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias(key), F.xxhash64(text_col).alias("h"))
    known = blocks.where(F.size(links) > 0).select(F.col(path).alias(key))
    # the sample is chosen by hash before any text moves; its paths are `sample_pages` at most
    chosen = F.broadcast(cut(wanted.join(known, key, "left_semi").orderBy("h", key).limit(sample_pages).select(key).distinct()))
    texts = docs.select(F.col(path_col).alias(key), F.col(text_col).alias("text")).join(chosen, key, "left_semi")
    marks = blocks.select(F.col(path).alias(key), F.col(links).alias("links")).join(chosen, key, "left_semi")
    return both, link_model(texts.join(marks, key)), links


def boilerplate_lines(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "clean_text", path_col: str = "raw_file_path", html_col: str = "html", sample_pages: int = 20_000) -> DataFrame:
    """(id_col, line_no): each non-empty line that is not main body."""
    flat = docs.select(id_col, text_col, *([path_col] if path_col in docs.columns else []))
    both, model, links = _linked(flat, pages, text_col, path_col, html_col, sample_pages)
    kind = flat.schema[id_col].dataType.simpleString()
    judged = map_lists(both.select(id_col, text_col, links), lambda i, t, k: [i, [furniture_lines(a, b, model) for a, b in zip(t, k)]], f"id {kind}, furniture array<int>", rows=128)
    return judged.select(F.col("id").alias(id_col), F.explode("furniture").alias("line_no")).distinct()


def main_body(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "clean_text", path_col: str = "raw_file_path", html_col: str = "html", sample_pages: int = 20_000) -> DataFrame:
    """`docs` with only the main body in `text_col`; other columns and rows as they were. Each row is judged by its own text."""
    both, model, links = _linked(docs, pages, text_col, path_col, html_col, sample_pages)
    at = docs.columns.index(text_col)

    def rule(*columns):
        *columns, marks = columns
        texts = []
        for text, own in zip(columns[at], marks):
            gone = set(furniture_lines(text, own, model))
            texts.append(text if not gone else "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone))
        columns[at] = texts
        return columns

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_lists(both.select(*docs.columns, links), rule, fields, rows=128)
