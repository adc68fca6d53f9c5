"""Web pages: charset, title, publication date, teaser, and the links of list pages, by the standard library's parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kildestrom.functions.dates import text_date
from kildestrom.functions.text import matches_name, strip_site_tail
from kildestrom.operators.intake import entry_time

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "noscript", "template"}
_ASIDE = {"aside", "nav", "footer"}
MOST_LINKS = 30
_BLOCKS = {"li", "tr", "article"}
_DAY_TEXT = re.compile(r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}\.? [^\W\d_]+ \d{4})\b")


def decode_page(data: bytes, header: str = "") -> str:
    """Text by byte-order mark, header, meta tag, UTF-8 if valid, else Western European."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    named = re.search(r"charset=[\"']?([\w-]+)", header or "")
    inner = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", data[:4096], re.I)
    for name in ([named[1]] if named else []) + ([inner[1].decode()] if inner else []) + ["utf-8"]:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.metas: dict[str, str] = {}
        self.heads: list[tuple[bool, str]] = []
        self.title, self.json_ld, self.times, self.paragraphs, self.links = "", [], [], [], []
        self.buffer: dict[str, list[str]] = {}
        self.href: str | None = None
        self.marks: list[set[str]] = []  # tag, .classes and #id of every open element
        self.blocks: list[list] = [[[], []]]  # times and texts of every list item, row or article
        self.open_blocks = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name and a.get("content") and name not in self.metas:
                self.metas[name] = a["content"]
        if tag == "time" and a.get("datetime") and not _ASIDE & set(self.stack):
            self.times.append(a["datetime"])
        if tag == "script":
            self.buffer["ld"] = [] if a.get("type", "").lower() == "application/ld+json" else None
        if tag in ("h1", "title", "p"):
            self.buffer[tag] = []
        if tag in _BLOCKS:
            self.open_blocks.append(len(self.blocks))
            self.blocks.append([[], []])
        if tag == "time" and a.get("datetime"):
            self.blocks[self.open_blocks[-1]][0].append(a["datetime"])
        own = {tag, *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])}
        if tag == "a" and a.get("href"):
            self.href, self.buffer["a"] = (a["href"], [*self.marks, own], self.open_blocks[-1]), []
        if tag not in _VOID:
            self.stack.append(tag)
            self.marks.append(own)

    def handle_endtag(self, tag: str) -> None:
        text = " ".join("".join(self.buffer.pop(tag, None) or []).split())
        if tag == "h1":
            self.heads.append((bool({"main", "article"} & set(self.stack)), text))
        elif tag == "title":
            self.title = self.title or text
        elif tag == "p" and text and not _ASIDE & set(self.stack):
            self.paragraphs.append((bool({"main", "article"} & set(self.stack)), text))
        elif tag == "a" and self.href:
            self.links.append((*self.href, text))
            self.href = None
        elif tag == "script" and self.buffer.get("ld") is not None:
            self.json_ld.append("".join(self.buffer.pop("ld")))
        if tag in _BLOCKS and len(self.open_blocks) > 1:
            self.open_blocks.pop()
        if tag in self.stack:
            while (self.marks.pop(), self.stack.pop())[1] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] in _SKIP:
            if self.buffer.get("ld") is not None:
                self.buffer["ld"].append(data)
            return
        for k, part in self.buffer.items():
            if part is not None and k != "ld":
                part.append(data)
        if data.strip():
            self.blocks[self.open_blocks[-1]][1].append(data.strip())


def _ld_dates(node: object, depth: int = 0) -> Iterator[str]:
    if depth > 8:
        return
    if isinstance(node, dict):
        if isinstance(node.get("datePublished"), str):
            yield node["datePublished"]
        for v in node.values():
            yield from _ld_dates(v, depth + 1)
    elif isinstance(node, list):
        for v in node:
            yield from _ld_dates(v, depth + 1)


def read_page(html: str | None, url: str = "") -> tuple:
    """(title, published, teaser, titles, dates, body) of a page.

    Titles come from og:title, the h1 of the main content, other h1 and title, dates from structured data, meta tags and
    time elements; the first of each is the page's. The body is the text of the main content's paragraphs, or of all.
    """
    p = _Page()
    p.feed(html or "")
    p.close()
    heads = [t for inside, t in sorted(p.heads, key=lambda h: not h[0]) if t]
    titles = [t for t in [p.metas.get("og:title", ""), *heads, p.title] if t.strip()]
    dates: list[str] = []
    for block in p.json_ld:
        try:
            dates += _ld_dates(json.loads(block))
        except ValueError:
            continue
    dates += [p.metas[k] for k in ("article:published_time", "datepublished", "date", "dc.date", "pubdate") if k in p.metas]
    in_url = re.search(r"/((?:19|20)\d\d)[/-](\d\d)[/-](\d\d)(?:[/-]|$)", url)
    dates += p.times + (["-".join(in_url.groups())] if in_url else [])
    ordered = sorted(p.paragraphs, key=lambda x: not x[0])
    teaser = next((t for t in [p.metas.get("og:description", ""), p.metas.get("description", ""), *(t for _, t in ordered if len(t) >= 40)] if t.strip()), None)
    main = [t for inside, t in ordered if inside] or [t for _, t in ordered]
    return next(iter(titles), None), next(iter(dates), None), teaser, titles, dates, "\n".join(main)


_PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "published", "teaser")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("titles", "dates")] + [T.StructField("body", T.StringType())])
_LINKS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "text", "date")]))


@F.pandas_udf(_PAGE)
def page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """struct<title, published, teaser, titles, dates, body> of pages; nulls and empty lists where nothing is found."""
    return pd.DataFrame([read_page(h, u or "") for h, u in zip(html, url, strict=True)], columns=["title", "published", "teaser", "titles", "dates", "body"])


def page_title(titles: Column, names: Column) -> Column:
    """The first title that isn't a bare name of the site, without the site's name behind it."""
    return F.get(F.transform(F.filter(titles, lambda t: ~matches_name(t, names)), lambda t: strip_site_tail(t, names)), F.lit(0))


def page_times(df: DataFrame, key: str, dates: str, body: str, now: Column) -> DataFrame:
    """Rows (key, at, quality): per page the first of its dates that lies between 2000 and two hours from now, else a day that its text tells."""
    early, late = F.lit("2000-01-01").cast("timestamp"), now + F.expr("interval 2 hours")
    each = df.select(key, F.posexplode_outer(dates).alias("nth", "date"))
    read = each.withColumn("at", entry_time(df.sparkSession, [F.col("date")])).filter(F.col("at").between(early, late))
    first = read.groupBy(key).agg(F.min_by("at", "nth").alias("named"))
    told = F.to_utc_timestamp(text_date(F.col(body), F.to_date(now)).cast("timestamp"), "Europe/Copenhagen")
    at = F.coalesce("named", told)
    return df.join(first, key, "left").select(key, at.alias("at"), F.when(at.isNull(), "fundet").otherwise("kilde").alias("quality"))


def _selected(marks: list[set[str]], selector: str) -> bool:
    """Whether open elements, the last of which is the link, meet a selector of tags, classes, ids and descent."""
    parts = [set(re.findall(r"[.#]?[\w-]+", part)) for part in selector.split()]
    if not parts or not parts[-1] <= marks[-1]:
        return not parts
    rest = iter(marks[:-1])
    return all(any(part <= m for m in rest) for part in parts[:-1])


def read_links(html: str | None, base: str, match: str = "", selector: str = "") -> list[tuple[str, str, str | None]]:
    """Absolute web links that are selected and match, with the longest text of each and the date beside it, at most MOST_LINKS.

    The date is that of a time element in the link's list item, row or article, else a date in its text.
    """
    p = _Page()
    p.feed(html or "")
    p.close()
    best: dict[str, tuple[str, str | None]] = {}
    for href, marks, block, text in p.links:
        u = urljoin(base, href).split("#")[0]
        if not u.startswith("http") or not re.search(match, u) or not any(_selected(marks, x) for x in (selector or "a").split(",")):
            continue
        times, texts = p.blocks[block] if block else ([], [])
        beside = next(iter(times), None) or next((m[0] for t in texts if (m := _DAY_TEXT.search(t))), None)
        if u not in best or len(text) > len(best[u][0]):
            best[u] = (text, beside or best.get(u, ("", None))[1])
    return [(u, *v) for u, v in best.items()][:MOST_LINKS]


@F.pandas_udf(_LINKS)
def links(html: pd.Series, base: pd.Series, match: pd.Series, selector: pd.Series) -> pd.Series:
    """array<struct<url, text, date>> of list pages."""
    return pd.Series([read_links(h, b or "", m or "", x or "") for h, b, m, x in zip(html, base, match, selector, strict=True)])
