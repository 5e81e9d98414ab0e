"""HTML pages as rows. A tokenizer gives the raw parts of a page; what is made of them are Spark expressions.

Broken markup never fails: what is left open ends with the page, and a null page has no parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactry.functions import normalize as norm
from contactry.operators import extract

# Fixed values.
HIDDEN = ("script", "style", "noscript", "svg", "iframe", "template")
TITLE, PAGE_TEXT, SOCIAL_TEXT = 180, 40_000, 50_000
SPA_TEXT, SPA_SCRIPTS = 250, 2
#: Characters of pages whose parts a task's Python holds at a time.
PIECE = 1 << 20
LINK_IN_TEXT = "(?i)https?://[^\\s<>\"']+"

#: Elements whose anchors belong to the page although their text does not.
_WITH_ANCHORS = ("svg", "template")
PARTS = (
    "title string, heading string, body string, anchors array<struct<text:string,href:string,shown:boolean>>, "
    "meta array<struct<name:string,content:string>>, data array<string>, feeds array<struct<type:string,href:string>>, scripts int"
)


class PageParts(HTMLParser):
    """The parts of one page, with entities decoded and tags dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heading = [], []
        self.body, self.anchors, self.meta, self.data, self.feeds, self.scripts = [], [], [], [], [], 0
        self.inside = ""  # the title or the first heading that is open
        self.seen: set[str] = set()
        self.hidden, self.depth = "", 0
        self.anchor: list | None = None
        self.is_data = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            self.depth += tag == self.hidden
            if self.hidden not in _WITH_ANCHORS or tag != "a":
                return
        has = dict(reversed(attrs))  # of a repeated attribute the first counts
        value = lambda name: has.get(name) or ""
        if tag == "a":
            self.close_anchor()
            if "href" in has:
                self.anchor = [[], value("href"), not self.hidden]
        elif tag == "meta" and "content" in has:
            self.meta.append((value("property") or value("name"), value("content")))
        elif tag == "link" and value("rel") == "alternate":
            self.feeds.append((value("type").lower(), value("href")))
        elif tag in ("title", "h1") and tag not in self.seen:
            self.inside = tag
            self.seen.add(tag)
        if tag in HIDDEN:
            self.hidden, self.depth = tag, 1
            if tag == "script":
                self.scripts += "src" in has
                self.is_data = value("type") == "application/ld+json"
                if self.is_data:
                    self.data.append("")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "a"):  # HTML knows no other empty elements written so
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden:
                self.depth -= 1
                if not self.depth:
                    self.hidden, self.is_data = "", False
            elif tag == "a" and self.hidden in _WITH_ANCHORS:
                self.close_anchor()
        elif tag == "a":
            self.close_anchor()
        elif tag == self.inside:
            self.inside = ""

    def handle_data(self, text: str) -> None:
        if self.anchor:
            self.anchor[0].append(text)
        if self.is_data:
            self.data[-1] += text
        if self.hidden:
            return
        if self.inside == "title":
            self.title.append(text)
            return
        if self.inside == "h1":
            self.heading.append(text)
        self.body.append(text)

    def close_anchor(self) -> None:
        if self.anchor:
            text, href, shown = self.anchor
            self.anchors.append(("".join(text).strip(), href, shown))
            self.anchor = None

    @classmethod
    def of(cls, html: str) -> tuple:
        page = cls()
        page.feed(html)
        page.close()
        page.close_anchor()
        text = "".join
        return text(page.title), text(page.heading), text(page.body), page.anchors, page.meta, page.data, page.feeds, page.scripts


_NAMES = ("title", "heading", "body", "anchors", "meta", "data", "feeds", "scripts")
_FIELDS = {"anchors": ("text", "href", "shown"), "meta": ("name", "content"), "feeds": ("type", "href")}


#: A script, whose text is no markup; or an ampersand of a reference that lacks its ";".
_BARE = re.compile(r"<script\b.*?(?:</script|\Z)|&(?=#?[0-9a-z]++(?!;))", re.I | re.S)


def _keep_bare(html: str) -> str:
    return _BARE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html)


def _pieces(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch in pieces of at most ``PIECE`` characters, or one page: their parts go back before the next are made."""
    filled = batch.fillna("").str.len().cumsum() // PIECE if len(batch) else batch
    yield from (piece for _, piece in batch.groupby(filled, sort=False))


def _parts(bare: bool) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in (piece for batch in pages for piece in _pieces(batch)):
            rows = [PageParts.of((x or "") if bare else _keep_bare(x or "")) for x in html]
            columns = {name: [r[i] for r in rows] for i, name in enumerate(_NAMES)}
            for name, fields in _FIELDS.items():
                columns[name] = [[dict(zip(fields, x, strict=True)) for x in cell] for cell in columns[name]]
            yield pd.DataFrame(columns)

    return parts


def page_parts(html: Column, bare: bool = True) -> Column:
    """A struct of title, heading, body, anchors, meta, data, feeds and scripts of a page.

    ``bare``: references that lack their ";" are decoded as a browser does; otherwise they stay as they are.
    """
    return F.pandas_udf(_parts(bare), PARTS)(html)


def _texts(parts: Column, name: str, field: str) -> Column:
    return F.transform(parts[name], lambda x: x[field])


def _filled(*choices: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))


def read_pages(pages: DataFrame, html: str = "html", url: str = "url", bare: bool = True) -> DataFrame:
    """The other columns, and title, text, emails, phones, social_urls, links, feeds, likely_spa of each page.

    Text is the body's, then anchors with their addresses, meta contents and structured data. Addresses in meta contents and
    structured data count as links for social_urls. ``links`` are as written, ``feeds`` are resolved. A page is likely made
    by scripts if it has hardly any text and loads several. ``bare`` as in ``page_parts``.
    """
    p = F.col("parts")
    rest = [c for c in pages.columns if c not in (html, url)]
    rows = pages.select(*rest, url, page_parts(F.col(html), bare).alias("parts"))
    spoken = F.array_join(F.transform(p["anchors"], lambda a: F.concat(a["text"], F.lit(" "), a["href"])), " ")
    extra = F.concat_ws(" ", F.array_join(_texts(p, "meta", "content"), " "), F.array_join(p["data"], " "))
    feeds = F.filter(p["feeds"], lambda f: f["type"].rlike("rss|atom|xml"))
    rows = rows.select(
        *rest, url,
        _filled(p["title"], p["heading"], F.col(url)).alias("title"),
        F.concat_ws(" ", p["body"], spoken, extra).alias("text"),
        F.transform(F.filter(p["anchors"], lambda a: a["shown"]), lambda a: a["href"]).alias("links"),
        F.regexp_extract_all(extra, F.lit(LINK_IN_TEXT), F.lit(0)).alias("embedded"),
        F.filter(F.transform(feeds, lambda f: norm.resolve(f["href"], F.col(url))), lambda f: f.isNotNull()).alias("feeds"),
        p["scripts"].alias("scripts"),
    )
    found = extract.page_channels(F.col("text"), F.concat("links", "embedded"), F.col(url))
    short = F.length(F.trim(F.regexp_replace("text", "\\s+", " "))) < SPA_TEXT
    return rows.select(
        *rest, url, norm.truncate(F.col("title"), TITLE).alias("title"), norm.truncate(F.col("text"), PAGE_TEXT).alias("text"),
        *found, "links", "feeds", (short & (F.col("scripts") >= SPA_SCRIPTS)).alias("likely_spa"),
    )


def read_social_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The other columns, and title, text, emails, phones, social_urls of public profile pages.

    Title and description for sharing come first; links are normalised and kept only on known platforms.
    """
    p = F.col("parts")
    rest = [c for c in pages.columns if c not in (html, url)]
    rows = pages.select(*rest, url, page_parts(F.col(html)).alias("parts"))
    meta = lambda name: F.try_element_at(F.transform(F.filter(p["meta"], lambda m: m["name"] == name), lambda m: m["content"]), F.lit(1))
    about = F.concat_ws(" ", _filled(meta("og:description")), _filled(meta("description")))
    rows = rows.select(
        *rest, url,
        norm.truncate(F.trim(_filled(meta("og:title"), p["title"], p["heading"], F.col(url))), TITLE).alias("title"),
        norm.truncate(F.concat_ws(" ", about, p["body"]), SOCIAL_TEXT).alias("text"),
        _texts(p, "anchors", "href").alias("links"),
    )
    named = F.concat("links", F.regexp_extract_all("text", F.lit("(?i)https?://[^\\s<>\"')\\]]+"), F.lit(0)))
    social = F.transform(named, lambda h: norm.let(norm.resolve(h, F.col(url)), norm.social_url))
    emails, phones, _ = extract.page_channels(F.col("text"), F.col("links"), F.col(url))
    return rows.select(*rest, url, "title", "text", emails, phones, F.array_distinct(F.filter(social, lambda s: s.isNotNull())).alias("social_urls"))
