"""Page HTML to structured text: a small reader in tasks, one pass over each page.

Headings become ``[H1] ...`` lines, and blocks whose text counts even when short get an ``[SB]`` mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.functions.text import GENERATORS, SCRIPT_SOURCES

#: Kinds of elements.
DROPPED = frozenset({"head", "nav", "footer", "script", "style", "noscript", "template"})
LEAVES = frozenset({"p", "dt", "dd", "td", "th", "blockquote", "figcaption", "address"})
BLOCKS = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "article", "section", "blockquote", "main", "ul", "ol", "table", "tr", "figure", "figcaption", "address"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: A start tag of the key ends open elements of the value, up to a barrier.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"td", "th", "tr", "li"} | {"header", "nav", "footer", "form", "pre", "hr", "dl", "dt", "dd", "li", "aside", "details", "fieldset"}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
P_BARRIERS = frozenset({"td", "th", "table", "button", "caption", "object", "marquee", "html", "body"})
_SPACE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TRIM = "".join(chr(k) for k in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_SCRIPTS = re.compile("|".join(SCRIPT_SOURCES), re.I)
_GENERATORS = re.compile(GENERATORS, re.I)
_PROTECTED = "/cdn-cgi/l/email-protection#"


def protected_email(code: str) -> str | None:
    """The address in a protected link: the first byte is the key of all others. None if it is malformed."""
    try:
        data = bytes.fromhex(code if len(code) % 2 == 0 else code[:-1])
    except ValueError:
        return None
    return "".join(chr(b ^ data[0]) for b in data[1:]) if data else None


class _Element:
    __slots__ = ("tag", "parts", "items", "silent")

    def __init__(self, tag: str, silent: bool):
        self.tag, self.silent = tag, silent
        self.parts: list[str] = []
        self.items: list[str] = []


class PageReader(HTMLParser):
    """Reads a page once and keeps its text, links and signs of a script framework."""

    def __init__(self, keep_nav_links: bool = False):
        super().__init__(convert_charrefs=True)
        self.keep_nav_links = keep_nav_links
        self.open = [_Element("#page", False)]
        self.links: list[str] = []
        self.framework = False

    # Elements

    def handle_starttag(self, tag, attributes):
        attrs = {}
        for k, v in attributes:
            attrs.setdefault(k, v or "")
        self._signs(tag, attrs)
        if tag in ("html", "body"):
            while len(self.open) > 1 and self.open[-1].tag == "head":
                self._close()
            return
        if tag in ENDS:
            self._end(ENDS[tag], BARRIERS[tag])
        if tag in ENDS_P:
            self._end({"p"}, P_BARRIERS)
        parent = self.open[-1]
        silent = parent.silent or tag in DROPPED
        if tag == "br":
            parent.parts.append("\n")
        email = None
        if tag == "a" and attrs.get("href", "").startswith(_PROTECTED):
            email = protected_email(attrs["href"][len(_PROTECTED) :].split("#")[0])
        if email is not None:
            if not parent.silent:
                parent.parts.append(email)
            silent = True
        elif tag == "a" and (not silent or self.keep_nav_links) and attrs.get("href") and not attrs["href"].startswith(("#", "mailto:")):
            self.links.append(attrs["href"])
        if tag in VOID:
            return
        self.open.append(_Element(tag, silent))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k].tag in ("td", "th", "table") and tag not in ("tr", "table", "td", "th", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data):
        top = self.open[-1]
        if not top.silent:
            top.parts.append(data)

    def _end(self, tags, barriers):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k].tag in barriers:
                return

    def _close(self):
        e = self.open.pop()
        parent = self.open[-1]
        if e.silent or parent.silent:
            return
        inner = "".join(e.parts)
        if e.tag in ("h1", "h2", "h3"):
            parent.parts.append(f"\n\n[{e.tag.upper()}] {inner.strip(_TRIM)}\n\n")
        elif e.tag in ("ul", "ol"):
            if e.items:
                parent.parts.append("\n\n[SB]" + ", ".join(e.items) + "\n\n")
        elif e.tag == "li" and parent.tag in ("ul", "ol"):
            item = re.sub("\n+", " ", inner.replace("[SB]", "")).strip(_TRIM)
            if item:
                parent.items.append(item)
        elif e.tag in LEAVES:
            bare = inner.replace("[SB]", "").strip(_TRIM)
            if bare:
                parent.parts.append(f"\n\n[SB]{bare}\n\n")
        elif e.tag in BLOCKS:
            parent.parts.append(f"\n\n{inner}\n\n")
        else:
            parent.parts.append(inner)

    # What else a page tells

    def _signs(self, tag, attrs):
        if tag == "script" and _SCRIPTS.search(attrs.get("src", "")):
            self.framework = True
        elif tag == "meta" and attrs.get("name") == "generator" and _GENERATORS.search(attrs.get("content", "")):
            self.framework = True
        elif "data-reactroot" in attrs or "data-v-app" in attrs or attrs.get("id") in ("__next", "__nuxt"):
            self.framework = True

    def text(self) -> str:
        while len(self.open) > 1:
            self._close()
        t = re.sub(r"[ \t]+", " ", "".join(self.open[0].parts))
        t = re.sub(r" *\n *", "\n", t)
        return re.sub(r"\n{3,}", "\n\n", t).strip(_TRIM)


def read_page(html: str | None, keep_nav_links: bool = False) -> dict:
    """Text, links and whether the page seems to need a browser to render. Links in dropped parts,
    such as navigation, are not followed unless ``keep_nav_links`` asks for them."""
    reader = PageReader(keep_nav_links)
    reader.feed(html or "")
    reader.close()
    text = reader.text()
    return {"text": text, "links": reader.links, "framework": reader.framework, "needs_render": reader.framework or "[H1]" not in text}


PAGE_TYPE = "struct<text: string, links: array<string>, framework: boolean, needs_render: boolean>"


def page_column(html: Column, keep_nav_links: bool = False) -> Column:
    """The struct of :func:`read_page` for a column of pages. Null pages read as empty."""
    @F.pandas_udf(PAGE_TYPE)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_page(h, keep_nav_links) for h in batch], columns=["text", "links", "framework", "needs_render"])

    return read(html)


def resolved_links(url: Column, links: Column) -> Column:
    """Absolute URLs of a page's links, those that can't be resolved left out."""

    @F.pandas_udf("array<string>")
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from urllib.parse import urljoin, urlsplit

        def one(base, hrefs):
            out = []
            for h in hrefs if hrefs is not None else ():
                try:
                    full = urljoin(base or "", h.strip())
                    if urlsplit(full).scheme in ("http", "https") and urlsplit(full).hostname:
                        out.append(full)
                except ValueError:
                    continue
            return out

        for urls, lists in batches:
            yield pd.Series([one(u, h) for u, h in zip(urls, lists)], dtype=object)

    return resolve(url, links)
