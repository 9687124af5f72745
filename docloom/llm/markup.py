"""Problem 5: residue of HTML, Markdown, wiki and LaTeX markup.

`strip_markup` finds the residue of each language by its rules and rewrites it: headings become lines of
their own, list lines start with the bullet sign, code is kept as it is written, formulas stay, links and
emphasis leave their text. Code is held apart first, so that no other rule touches it. Then the line-block
distribution decides what is text: the lengths of the lines, of which lines that are nothing but a link have
none, are summed over a sliding window; a surge of the sum opens a stretch of text, a dive to nothing
closes it, and what lies outside all stretches (debris of markup, lists of links) goes. Lines that the
rewriting knows as heading, list item, code or formula stay wherever they are.

The rows of `residue_rows` are the languages that the first step of the same pass found in each field.
They do not depend on the line-block distribution, which says where text is and not what markup is.

Everything is per row: no shuffle, one Arrow pass, each language guarded by the characters it needs.

Defined results: null stays null and has no residue; an empty text stays empty. Bare code lines,
prices, comparisons, generics such as Map<a, b>, globs and the bullet sign are not markup.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import free_name, map_lists

LANGUAGES = ("html", "markdown", "wiki", "latex")

# The element names of HTML that count as tags.
_ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link "
    "main map mark meta nav noscript object ol optgroup option p param picture pre q ruby rp rt s samp script section select small source span "
    "strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
_TAG = re.compile(r"</?(?:" + "|".join(sorted(_ELEMENTS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>|<!--|<!doctype\b[^<>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")

_MD_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$", re.M)
_MD_HEAD = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(?!\[\[)(\S.*?)[ \t]*#*[ \t]*$", re.M)
_MD_BOLD = re.compile(r"(?<![\w*/\\'\"])\*\*(?=[^\s*/.])([^*\n]*[^\s*])\*\*(?![\w*/])")
_MD_EM = re.compile(r"(?<![\w*/\\'\"_.])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])")
_MD_STRONG = re.compile(r"(?<![\w*/\\'\"_.(])__(?=[^\s_])([^_\n]*[^\s_])__(?![\w_])(?=.*\S)")
_MD_CODE = re.compile(r"(?<!`)`(?![`\s'])([^`\n]*[^`\s])`(?!`)")
_MD_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$", re.M)
_MD_ANCHOR = re.compile(r"[ \t]*\{#[\w-]+\}[ \t]*$", re.M)
_MD_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]*[^\s~])~~(?!~)")
_MD_ITEM = re.compile(r"^([ \t]*)(?:[*+-]|[0-9]{1,3}\.)[ \t]+(?=\S)", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$", re.M)

_WK_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]")
_WK_CALL = re.compile(r"\{\{((?:[^{}\n]|\{[^{}\n]*\})+)\}\}")
_WK_CITE = re.compile(r"[ ]*(?:cit[a-z]*|refs?|refn|efn|sfn|fn)(?:[ ][^|]*)?\|", re.I)
_WK_QUOTE = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_WK_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n](?:.*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WK_TABLE = re.compile(r"^[ \t]*(?:\{\|.*|\|\}|\|-+|\|\+.*)[ \t]*$", re.M)
_WK_TABLE_LINE = re.compile(_WK_TABLE.pattern + r"\n?", re.M)
_WK_CELLS = re.compile(r"^[ \t]*[!|][ \t]*(.+(?:!!|\|\|).+)$", re.M)
_WK_ITEM = re.compile(r"^[*#:;]+(?:[ \t]+(?=\S)|(?=\[\[|''))")

_TX_ENV = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})?")
_TX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}")
_TX_GONE = re.compile(r"~?\\(?:label|index|vspace|hspace|bibliography|usepackage|documentclass|pagestyle|input|include|ref|eqref|pageref|cite[a-z]*)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_TX_TEXT = re.compile(r"\\(?:text(?:bf|tt|it|sc|sf|rm|up)|emph|underline|mbox|url|footnote|caption|title|author)\{([^{}\n]*)\}")
_TX_HREF = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_TX_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*", re.M)
_TX_MATH = re.compile(r"\$(?=[^\s$])(?:[^$\n]*?[\\^_{}][^$\n]*?)\$|\\\[[^\n]*?\\\]|\\\((?=[^\n]*\\\))")
_TX_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\{)")


def residue(text: str | None) -> tuple[str, ...]:
    """The languages whose markup a text holds."""
    if not text:
        return ()
    found = []
    if "<" in text and _TAG.search(text) or "&" in text and _ENTITY.search(text):
        found.append("html")
    if (
        "](" in text and _MD_LINK.search(text)
        or "#" in text and (_MD_HEAD.search(text) or "{#" in text and _MD_ANCHOR.search(text))
        or "**" in text and _MD_BOLD.search(text)
        or "`" in text and (_MD_CODE.search(text) or _MD_FENCE.search(text))
        or "_" in text and _MD_EM.search(text)
        or "--" in text and "|" in text and _MD_RULE.search(text)
        or "~~" in text and (_MD_STRIKE.search(text) or _MD_FENCE.search(text))
    ):
        found.append("markdown")
    if (
        "[[" in text and _WK_LINK.search(text)
        or "{{" in text and _WK_CALL.search(text)
        or "''" in text and _WK_QUOTE.search(text)
        or "==" in text and _WK_HEAD.search(text)
        or "{|" in text and _WK_TABLE.search(text)
    ):
        found.append("wiki")
    if "\\" in text and (_TX_ENV.search(text) or _TX_COMMAND.search(text) or _TX_MATH.search(text) or _TX_ITEM.search(text)) or "$" in text and _TX_MATH.search(text):
        found.append("latex")
    return tuple(found)


# Marks that the rules leave in a text, of characters that no text holds: a break, a line of code, a heading, a line that is one link, something held.
_BREAK, _CODE, _HEAD, _LINK, _HELD = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"

_FENCED = re.compile(r"^[ \t]*(```|~~~)[\w+-]*[ \t]*(?:\n|\Z)(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})?\n?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
_HELD_AT = re.compile(f"{_HELD}([0-9]+){_HELD}")
_HTML_LINK_ITEM = re.compile(r"<li\b[^<>]*>\s*(?=<a\b[^<>]*>(?:(?!</a).)*</a\s*>\s*</li\s*>)", re.S | re.I)
_WK_LINK_ITEM = re.compile(r"^[*#:;]+[ \t]*(?=\[\[[^\[\]\n]+\]\][ \t]*$)", re.M)
_MD_LINK_ITEM = re.compile(r"^([ \t]*)(?:[*+-]|[0-9]{1,3}\.)[ \t]+(?=\[[^\[\]\n]*\]\([^()\s]+\)[ \t]*$)", re.M)
_FORMULA = re.compile(r"\$\$|\\begin\{(?:equation|align|math|displaymath)")


def _unescape(text: str) -> str:
    for _ in range(2):  # some entities are escaped twice
        text = html.unescape(text)
    return text.replace("\xa0", " ")


def _hold_code(text: str, found: tuple[str, ...], held: list[str]) -> str:
    """The text with its code taken out."""

    def hold(content: str) -> str:
        held.append(content)
        return f"{_HELD}{len(held) - 1}{_HELD}"

    def block(content: str, indent: str) -> str:
        return hold("\n".join(_CODE + indent + x for x in content.strip("\n").split("\n"))) if content.strip() else ""

    if "markdown" in found and ("```" in text or "~~~" in text):
        text = _FENCED.sub(lambda m: block(m[2], "    "), text)
    if "latex" in found and "\\begin{" in text:
        text = _VERBATIM.sub(lambda m: block(m[2], "    "), text)
    if "html" in found and "<" in text:
        text = _PRE.sub(lambda m: _BREAK + block(_unescape(_TAG.sub("", m[1])), "") + _BREAK, text)
    if "markdown" in found and "`" in text:
        text = _MD_CODE.sub(lambda m: hold(m[1]), text)
    return text


def _from_html(text: str) -> str:
    text = _COMMENT.sub("", text)
    text = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", "", text, flags=re.I | re.S)
    text = re.sub(r"[ \t]*<(?:h[1-6]|title)\b[^<>]*>[ \t]*", _BREAK + _HEAD, text, flags=re.I)
    text = _HTML_LINK_ITEM.sub(f"{_BREAK}• {_LINK}", text)
    text = re.sub(r"[ \t]*<li\b[^<>]*>[ \t]*", f"{_BREAK}• ", text, flags=re.I)
    text = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", text, flags=re.I)
    text = re.sub(r"</?(?:h[1-6]|title|li|p|div|tr|table|ul|ol|blockquote|section|article)\b[^<>]*>", _BREAK, text, flags=re.I)
    text = re.sub(r"<br\b[^<>]*>", " ", text, flags=re.I)
    return _unescape(_TAG.sub("", text))


def _wiki_items(text: str) -> str:
    """Bullets for wiki list lines: those with wiki markup, and runs of two and more; a single "# line" is none."""
    lines = text.split("\n")
    item = [bool(_WK_ITEM.match(x)) for x in lines]
    for i, line in enumerate(lines):
        if item[i] and (line[0] in "*:;" or _WK_LINK.search(line) or _WK_QUOTE.search(line) or i and item[i - 1] or i + 1 < len(lines) and item[i + 1]):
            lines[i] = _WK_ITEM.sub("• ", line)
    return "\n".join(lines)


def _from_wiki(text: str) -> str:
    text = _WK_HEAD.sub(_HEAD + r"\2", text)
    text = _WK_TABLE_LINE.sub("", text)
    text = _WK_CELLS.sub(lambda m: " | ".join(x.strip() for x in re.split(r"!!|\|\|", m[1])), text)
    text = _wiki_items(_WK_LINK_ITEM.sub(f"• {_LINK}", text))
    text = _WK_LINK.sub(r"\1", text)
    text = _WK_CALL.sub(lambda m: "" if _WK_CITE.match(m[1]) else re.sub(r"^\d+=", "", m[1].partition("|")[2] or m[1]), text)
    return _WK_QUOTE.sub(r"\2", text)


def _from_markdown(text: str) -> str:
    out = []
    for line in text.split("\n"):
        if _MD_FENCE.match(line) or _MD_RULE.match(line):
            continue
        line = _MD_ANCHOR.sub("", _MD_HEAD.sub(_HEAD + r"\2", line))
        line = _MD_ITEM.sub(r"\1• ", _MD_LINK_ITEM.sub(rf"\1• {_LINK}", line))
        line = _MD_LINK.sub(r"\2", line)
        line = _MD_EM.sub(r"\1", _MD_STRIKE.sub(r"\1", _MD_BOLD.sub(r"\1", line)))
        out.append(_MD_ROW.sub(lambda m: m[1].strip(), line))
    return "\n".join(out)


def _from_latex(text: str) -> str:
    out = []
    for line in text.split("\n"):
        env = _TX_ENV.search(line)
        line = _TX_HEAD.sub(_HEAD + r"\1", _TX_GONE.sub("", line))
        line = _TX_ITEM.sub(lambda m: "• " + (m[1] + " " if m[1] else ""), line)
        line = line if not _TX_ENV.search(line) or _FORMULA.search(line) or re.search(r"\\end\{(?:equation|align|math|displaymath)", line) else _TX_ENV.sub("", line)
        line = _TX_HREF.sub(r"\1", line)
        for _ in range(3):
            line = _TX_TEXT.sub(r"\1", line)
        if line.strip() or not env:
            out.append(line)
    return "\n".join(out)


_RULES = (("html", _from_html), ("wiki", _from_wiki), ("markdown", _from_markdown), ("latex", _from_latex))


def _wide(c: str) -> bool:
    return "\u1100" <= c <= "\u11ff" or "\u2e80" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000"


def _size(line: str) -> int:
    """The length of a line, in which a CJK character says as much as three letters."""
    line = line.strip()
    return len(line) if line.isascii() else len(line) + 2 * sum(map(_wide, line))


def text_spans(sizes: list[int], window: int = 3, surge: int = 60) -> list[tuple[int, int]]:
    """Line-block distribution: the stretches [first, last) of lines that are text. A block is the summed length of `window`
    lines; a block above `surge` opens a stretch, with the lines that touch it from above; a dive, a block
    without any text, closes it. Without any surge all lines stay."""
    n, out, i = len(sizes), [], 0
    blocks = [sum(sizes[k : k + window]) for k in range(n)]
    while i < n:
        if blocks[i] <= surge:
            i += 1
            continue
        first, low = next(k for k in range(i, n) if sizes[k]), out[-1][1] if out else 0
        while first > low and sizes[first - 1]:
            first -= 1
        while i < n and blocks[i]:
            i += 1
        out.append((first, i))
    return out or [(0, n)]


def plain_text(text: str | None, found: tuple[str, ...] | None = None) -> str | None:
    """The text without markup; a text without residue comes back as it is."""
    if text is None:
        return None
    found = residue(text) if found is None else found
    if not found:
        return text
    held: list[str] = []
    text = _hold_code(text, found, held)
    for name, rule in _RULES:
        if name in found:
            text = rule(text)
    text = re.sub(f"\n?{_BREAK}(?:[ \t]*\n?[ \t]*{_BREAK})*\n?", "\n", text)
    while _HELD in text:
        text = _HELD_AT.sub(lambda m: held[int(m[1])], text)
    lines = text.split("\n")
    stays = [_CODE in x or _HEAD in x or _LINK not in x and _is_marked(x) for x in lines]
    links = [_LINK in x for x in lines]
    lines = [re.sub(f"[{_BREAK}-{_HELD}]", "", x).rstrip() for x in lines]
    spans = text_spans([0 if link else _size(x) for x, link in zip(lines, links)])
    inside = [False] * len(lines)
    for a, b in spans:
        inside[a:b] = [True] * (b - a)
    out, blank, kept = [], [], False
    for x, keep, mark in zip(lines, inside, stays):
        if not x.strip():
            blank.append(x)  # empty lines stay between lines that stay
            continue
        now = keep or mark
        out += [*(blank if kept and now else []), x] if now else []
        blank, kept = [], now
    return "\n".join(out)


def _is_marked(line: str) -> bool:
    """Whether a rewritten line is a list item or a formula."""
    return line.lstrip().startswith("• ") or bool(_FORMULA.search(line) or _TX_MATH.search(line))


def strip_markup(docs: DataFrame, text_cols: tuple[str, ...] = ("clean_text", "section_title"), suffix: str = "_markup") -> DataFrame:
    """`docs` with each of `text_cols` as plain text and, beside it, `<column><suffix>`: the languages found in it."""
    marks = [free_name(docs, c + suffix) for c in text_cols]
    before = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at = [docs.columns.index(c) for c in text_cols]

    def rule(*columns):
        columns, flags = list(columns), []
        for i in at:
            flags.append([list(residue(t)) for t in columns[i]])
            columns[i] = [plain_text(t, tuple(f)) for t, f in zip(columns[i], flags[-1])]
        return columns + flags

    return map_lists(docs, rule, ", ".join(before + [f"`{m}` array<string>" for m in marks]))


def residue_rows(docs: DataFrame, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("clean_text", "section_title")) -> DataFrame:
    """(id_col, field_name, markup): one row per distinct id, field and language with residue."""
    clean = strip_markup(docs.select(id_col, *text_cols), text_cols, "_markup")
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(f"{c}_markup").alias("found")) for c in text_cols))
    return (
        clean.select(F.col(id_col), F.explode(fields).alias("x"))
        .select(F.col(id_col), "x.field_name", F.explode("x.found").alias("markup"))
        .distinct()
    )
