"""Title, section, main text and links of an HTML page, in one parse a page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from docloom.config import DROPPED_CLASSES, DROPPED_TAGS, MAIN_CLASSES, MAIN_TAGS, NOISE_LINES

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_NAMED = ("title", "h1", "h2")
_NOISE = frozenset(NOISE_LINES)


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class _Page(HTMLParser):
    """Text nodes of the whole page and of every candidate for its main part, the title, the first
    heading of each level, and the links (those of dropped elements too)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list | None]] = []  # tag, dropped, text of a main candidate
        self.all: list[str] = []
        self.candidates: list[list[str]] = []
        self.first: dict[str, list[str]] = {}
        self.closed: set[str] = set()
        self.links: list[str] = []

    def _dropped(self) -> bool:
        return any(d for _, d, _ in self.open)

    def handle_starttag(self, tag, attrs):
        kept = dict(attrs)
        if tag == "a" and kept.get("href") is not None:
            self.links.append(kept["href"])
        if tag in _VOID:
            return
        classes = set((kept.get("class") or "").split())
        dropped = tag in DROPPED_TAGS or not classes.isdisjoint(DROPPED_CLASSES)
        region = None
        if not dropped and not self._dropped():
            if tag in MAIN_TAGS or kept.get("role") == "main" or not classes.isdisjoint(MAIN_CLASSES):
                region = []
                self.candidates.append(region)
            if tag in _NAMED:
                self.first.setdefault(tag, [])
        self.open.append((tag, dropped, region))

    def handle_endtag(self, tag):
        if tag in self.first:
            self.closed.add(tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self._dropped():
            return
        tags = {t for t, _, _ in self.open}
        for tag in _NAMED:
            if tag in tags and tag not in self.closed:
                self.first[tag].append(data)
        text = data.strip()
        if text and _SILENT.isdisjoint(tags):
            self.all.append(text)
            for _, _, region in self.open:
                if region is not None:
                    region.append(text)


def extract_page(page: str | None) -> tuple[str, str, str, list[str]]:
    """(title, section, text, links)."""
    parser = _Page()
    try:
        parser.feed(page or "")
        parser.close()
    except (AssertionError, ValueError):
        pass  # what was read so far counts
    title = _tidy("".join(parser.first.get("title", []))) or "Untitled"
    section = next((_tidy(" ".join(t.strip() for t in parser.first[h] if t.strip())) for h in ("h1", "h2") if h in parser.first), "")
    region = max(parser.candidates, key=lambda r: len(" ".join(r))) if parser.candidates else parser.all
    lines = [x.strip() for x in _tidy("\n".join(region)).splitlines()]
    text = _tidy("\n".join(x for x in lines if x and x.lower() not in _NOISE))
    return title, section, text, parser.links


def parse_html(page):
    """struct(title, section_title, clean_text, links) of an HTML column."""

    @F.pandas_udf("title string, section_title string, clean_text string, links array<string>")
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_page(p) for p in pages], columns=["title", "section_title", "clean_text", "links"])

    return parse(page)
