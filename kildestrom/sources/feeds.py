"""Feeds as data: RSS and Atom, search engines' links, sitemaps, parliament documents. Parsing is safe against entities."""

from __future__ import annotations

import base64
import gzip
import re
import zlib
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that one document may unpack to.
MOST_BYTES = 50_000_000
_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("link", "title", "teaser", "published")] + [T.StructField("categories", T.ArrayType(T.StringType()))])
_FEED = T.StructType([T.StructField("is_feed", T.BooleanType()), T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("problem", T.StringType())])
_PLACE = T.StructType([T.StructField(n, T.StringType()) for n in ("loc", "lastmod", "title", "published")])
_MAP = T.StructType([T.StructField("kind", T.StringType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("problem", T.StringType())])


class Refused(ValueError):
    """A document that isn't parsed: too large, broken, or declaring a document type."""


def unpack(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Plain bytes of gzipped ones; a document of more than `most` bytes is refused while it is unpacked."""
    if data[:2] == b"\x1f\x8b":
        machine = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            data = machine.decompress(data, most + 1)
        except zlib.error as e:
            raise Refused("broken") from e
    if len(data) > most:
        raise Refused("too large")
    return data


class _Root(Exception):
    pass


def _has_doctype(data: bytes) -> bool:
    """Whether a document type is declared before the root element, however far into the document that is."""
    parser = expat.ParserCreate()

    def stop(kind: bool):
        def handler(*args: object) -> None:
            raise _Root(kind)

        return handler

    parser.StartDoctypeDeclHandler, parser.StartElementHandler = stop(True), stop(False)
    try:
        parser.Parse(data, True)
    except _Root as e:
        return e.args[0]
    return False


def parse_xml(data: bytes) -> ElementTree.Element:
    """The root; malformed documents and those that declare a document type are refused."""
    try:
        if _has_doctype(data):
            raise Refused("document type")
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, expat.ExpatError, LookupError) as e:
        raise Refused("malformed") from e


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _text(e: ElementTree.Element, *names: str) -> str | None:
    for n in names:
        for c in e:
            if _name(c) == n and (t := "".join(c.itertext()).strip()):
                return t
    return None


def _link(e: ElementTree.Element) -> str | None:
    links = [c for c in e if _name(c) == "link"]
    for c in links:
        if (c.get("rel") or "alternate") == "alternate" and (u := c.get("href") or (c.text or "").strip()):
            return u
    for c in links:
        if u := c.get("href") or (c.text or "").strip():
            return u
    own = _text(e, "guid", "id")
    return own if own and own.startswith("http") else None


def read_feed(data: bytes) -> tuple[bool, list[tuple], str | None]:
    """Whether the document is a feed, its entries (link, title, teaser, published, categories), and why it was refused."""
    try:
        root = parse_xml(unpack(data))
    except Refused as e:
        return False, [], str(e)
    if _name(root) not in ("rss", "feed", "rdf"):
        return False, [], "no feed"
    out = []
    for e in root.iter():
        if _name(e) in ("item", "entry"):
            terms = [(c.get("term") or c.text or "").strip()[:80] for c in e if _name(c) == "category"]
            out.append((_link(e), _text(e, "title"), _text(e, "description", "summary", "encoded", "content"), _text(e, "pubdate", "published", "date", "updated", "created"), list(dict.fromkeys(t for t in terms if t))[:10]))
    return True, out, None


def _bytes(x: object) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x or b"")


@F.pandas_udf(_FEED)
def feed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct<is_feed, entries, problem> of feed documents, as text or bytes."""
    for s in batches:
        yield pd.DataFrame([read_feed(_bytes(x)) for x in s], columns=["is_feed", "entries", "problem"])


def read_sitemap(data: bytes) -> tuple[str | None, list[tuple], str | None]:
    """urlset or index, with (loc, lastmod, title, published) of its places, and why it was refused."""
    try:
        root = parse_xml(unpack(data))
    except Refused as e:
        return None, [], str(e)
    kind = {"urlset": "urlset", "sitemapindex": "index"}.get(_name(root))
    if kind is None:
        return None, [], "no sitemap"
    out = []
    for e in root:
        news = next((c for c in e if _name(c) == "news"), e)
        out.append((_text(e, "loc"), _text(e, "lastmod"), _text(news, "title"), _text(news, "publication_date")))
    return kind, [x for x in out if x[0]], None


@F.pandas_udf(_MAP)
def sitemap(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct<kind, places, problem> of sitemap documents; kind is null for anything else."""
    for s in batches:
        yield pd.DataFrame([read_sitemap(_bytes(x)) for x in s], columns=["kind", "places", "problem"])


def newest_maps(places: DataFrame, document: str, n: int) -> DataFrame:
    """The n places of each index that are newest by lastmod, date in the address, and position."""
    from kildestrom.operators.ranking import top_per

    dated = places.withColumn("url_date", url_date(F.col("loc")))
    return top_per(dated, [document], [F.col("lastmod").desc_nulls_last(), F.col("url_date").desc_nulls_last(), F.col("position").desc()], n)


def url_date(url: Column) -> Column:
    """A /2026/02/03/ or 2026-02-03 in the path, if it is a date."""
    a = F.regexp_extract(url, r"/((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/-]|$)", 0)
    parts = F.regexp_extract_all(a, F.lit(r"(\d+)"), 1)
    return F.when(a != "", F.try_make_date(parts[0].cast("int"), parts[1].cast("int"), parts[2].cast("int"))) if hasattr(F, "try_make_date") else F.when(a != "", F.to_date(F.try_to_timestamp(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), F.lit("yyyy-MM-dd"))))


def expand_days(template: Column, since: Column, until: Column) -> Column:
    """Addresses with {dato} replaced by every day from the later day back."""
    days = F.sequence(until, since, F.expr("interval -1 day"))
    return F.when(template.contains("{dato}"), F.transform(days, lambda d: F.replace(template, F.lit("{dato}"), F.date_format(d, "yyyy-MM-dd")))).otherwise(F.array(template))


def search_address(template: Column, query: Column, when: Column) -> Column:
    """A search address from a template with {q} and {when}."""
    return F.replace(F.replace(template, F.lit("{q}"), F.url_encode(query)), F.lit("{when}"), F.url_encode(when))


def engine_of(host: Column) -> Column:
    """google, bing or other."""
    return F.when(host.rlike(r"(^|\.)google\.[a-z.]+$"), "google").when(host.rlike(r"(^|\.)bing\.com$"), "bing").otherwise("other")


def bing_target(url: Column) -> Column:
    """The address that a link of this engine leads to, else the link."""
    named = [F.try_url_decode(F.regexp_extract(url, f"[?&]{k}=([^&#]+)", 1)) for k in ("url", "URL", "u")]
    return F.coalesce(*[F.when(x.startswith("http"), x) for x in named], url)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while at < len(data) and shift < 64:
        value |= (data[at] & 0x7F) << shift
        at += 1
        if not data[at - 1] & 0x80:
            break
        shift += 7
    return value, at


def embedded_url(data: bytes, depth: int = 0) -> str | None:
    """The first web address in a length-delimited field of a message, or of one inside it."""
    at = 0
    while at < len(data) and depth < 5:
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            n, at = _varint(data, at)
            part = data[at : at + n]
            at += n
            if part.startswith(b"http") and (m := re.match(rb"https?://[\x21-\x7e]+", part)):
                return m[0].decode()
            if part and (found := embedded_url(part, depth + 1)):
                return found
        elif tag & 7 == 0:
            _, at = _varint(data, at)
        elif tag & 7 in (1, 5):
            at += 8 if tag & 7 == 1 else 4
        else:
            return None
    return None


@F.pandas_udf(T.StringType())
def encoded_target(urls: pd.Series) -> pd.Series:
    """The address hidden in the last path part of an engine's link (base64 of a message), else null."""

    def one(u: str | None) -> str | None:
        token = re.sub(r"[?#].*", "", u or "").rstrip("/").rpartition("/")[2]
        try:
            return embedded_url(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        except ValueError:
            return None

    return urls.map(one)


ODATA = "array<struct<id:bigint,titel:string,dato:string,frigivelsesdato:string,offentlighedskode:string,Dokumenttype:struct<type:string>,Fil:array<struct<filurl:string,variantkode:string>>>>"


def odata(pages: DataFrame, text: str, skip_types: list[str]) -> DataFrame:
    """Documents of JSON pages {value: [...]}: public ones of other types, with their PDF or else first file.

    A page that is no such JSON gives none; `skipped` says why a document is left out, null if it isn't.
    """
    rows = pages.select(F.explode_outer(F.from_json(text, f"value {ODATA}")["value"]).alias("d")).filter("d is not null").select("d.*")
    pdf = F.filter("Fil", lambda f: f["variantkode"] == "P")
    skipped = F.when(F.col("offentlighedskode") != "O", "not public").when(F.col("Dokumenttype.type").isin(*skip_types), "type").when(F.coalesce(F.size("Fil"), F.lit(0)) == 0, "no file")
    return rows.select("id", F.trim("titel").alias("titel"), F.coalesce("frigivelsesdato", "dato").alias("published"), F.coalesce(F.get(pdf, F.lit(0)), F.get("Fil", F.lit(0)))["filurl"].alias("url"), skipped.alias("skipped"))


def gzipped(data: bytes) -> bytes:
    """For fixtures."""
    return gzip.compress(data)


def rfc822(text: str) -> object:
    """A mail date as datetime, or None."""
    try:
        return parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
