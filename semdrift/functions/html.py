"""Main text of an HTML page.

Two ways: an event walk over the markup in Arrow batches, which reads nested
and unclosed parts as a parser does, and column expressions for flat pages.
The walk is the default; on the fixture pages it is also the faster one (see
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from semdrift.functions.text import collapse_space

# Subtrees without content, containers by preference, common entities.
BOILERPLATE = ("nav", "header", "footer", "script", "style")
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&sect;", "§"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
CODE = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
FRAME = r"(?is)<(nav|header|footer)\b[^>]*>.*?</\1\s*>"
TAG = r"""<[!/a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
CONTAINERS = (
    r"(?is)<main\b[^>]*>(.*?)</main\s*>",
    r"(?is)<article\b[^>]*>(.*?)</article\s*>",
    # A content division without further ones in it; nested ones are left to the walk.
    r"""(?is)<div\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?content(?:\s[^"']*)?["'][^>]*>((?:(?!<div\b).)*?)</div\s*>""",
    r"(?is)<body\b[^>]*>(.*)</body\s*>",
)


def strip_boilerplate(html: Column) -> Column:
    """Code, comments and page frames become a space."""
    for part in (CODE, COMMENT, FRAME):
        html = F.regexp_replace(html, part, " ")
    return html


def main_content(html: Column) -> Column:
    """Inner HTML of the preferred container, NULL when the page has none."""
    return F.coalesce(*[F.when(html.rlike(p), F.regexp_extract(html, p, 1)) for p in CONTAINERS])


def visible_text(html: Column) -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    text = F.regexp_replace(html, TAG, " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return collapse_space(text)


class _Walk(HTMLParser):
    """Collects the text below the first main, article, div.content and body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.skipped = 0
        self.found: list[list[str] | None] = [None] * 4
        self.active: set[int] = set()

    def _container(self, tag: str, attrs: list) -> int | None:
        if tag == "div":
            classes = (dict(attrs).get("class") or "").split()
            rank = 2 if "content" in classes else None
        else:
            rank = {"main": 0, "article": 1, "body": 3}.get(tag)
        return rank if rank is not None and self.found[rank] is None else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        rank = None
        if tag in BOILERPLATE:
            self.skipped += 1
        elif not self.skipped:
            rank = self._container(tag, attrs)
            if rank is not None:
                self.found[rank] = []
                self.active.add(rank)
        self.open.append((tag, rank))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(name == tag for name, _ in self.open):
            return
        while self.open:
            name, rank = self.open.pop()
            if name in BOILERPLATE:
                self.skipped -= 1
            if rank is not None:
                self.active.discard(rank)
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            for rank in self.active:
                self.found[rank].append(data)


def walk_text(html: str) -> str | None:
    walk = _Walk()
    walk.feed(html)
    walk.close()
    for pieces in walk.found:
        if pieces is not None:
            return " ".join(" ".join(pieces).split())
    return None


def _read_pages(pages: pd.Series) -> pd.DataFrame:
    texts, errors = [], []
    for page in pages:
        text = error = None
        if page is not None:
            try:
                text = walk_text(page)
            except Exception as exc:  # one bad page must not end the job
                error = f"{type(exc).__name__}: {exc}"
        texts.append(text)
        errors.append(error)
    return pd.DataFrame({"text": texts, "error": errors}, dtype="object")


def page_text_by_columns(html: Column) -> Column:
    return visible_text(main_content(strip_boilerplate(html)))


def page_text_by_walk(html: Column) -> Column:
    """Struct of text and error; a page that fails has NULL text."""
    return F.pandas_udf(_read_pages, "struct<text: string, error: string>")(html)
