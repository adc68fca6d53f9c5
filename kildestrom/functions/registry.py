"""Names, hosts and addresses of a source registry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kildestrom.functions.text import slug
from kildestrom.functions.urls import host_of

# Where sites usually keep their feeds.
FEED_PATHS = ["/rss", "/feed", "/rss.xml", "/feed.xml", "/atom.xml", "/nyheder/rss"]


def source_hosts(homepage: Column, domains: Column) -> Column:
    """The homepage's host and the registered domains, in order, each once."""
    hosts = F.concat(F.array(host_of(homepage)), F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: host_of(d)))
    return F.array_distinct(F.filter(hosts, lambda h: h.isNotNull() & (h != "")))


def other_domains(homepage: Column, domains: Column) -> Column:
    """Domains that don't lie on the homepage's site."""
    home = host_of(homepage)
    return F.filter(domains, lambda d: (d != home) & ~d.endswith(F.concat(F.lit("."), home)) & ~home.endswith(F.concat(F.lit("."), d)))


def site_names(name: Column, hosts: Column) -> Column:
    """What a site may call itself: its name, the name without and inside parentheses, its hosts."""
    inside = F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1)
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    return F.array_distinct(F.filter(F.concat(F.array(name, bare), inside, hosts), lambda x: x != ""))


def slug_text(url: Column) -> Column:
    """The words of an address's path: its last part decoded, signs as blanks."""
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(path), path), r"[^\p{L}\p{N}]+", " "))


def feed_addresses(homepage: Column) -> Column:
    """Addresses at which a feed may lie, likeliest first."""
    base = F.regexp_replace(homepage, "/+$", "")
    return F.array_distinct(F.array(*[F.concat(base, F.lit(p)) for p in FEED_PATHS]))


def population(text: Column) -> Column:
    """A number with dots between thousands and a decimal comma as whole number, its fraction dropped; null for anything else."""
    bare = F.regexp_replace(F.trim(text), r"[.\s]", "")
    return F.when(bare.rlike(r"^-?\d+(,\d*)?$"), F.regexp_extract(bare, r"^(-?\d+)", 1).cast("bigint"))


def place_id(kind: Column, name: Column) -> Column:
    """The id a place should have: kind, colon and the slug of its name."""
    return F.concat(kind, F.lit(":"), slug(name))


def category_of(text: Column, categories: list[str]) -> Column:
    """The category that a free text names, as a whole or by one of its parts; null if none."""
    whole = slug(text)
    parts = F.split(whole, "-")
    known = F.array(*[F.lit(c) for c in categories])
    first = F.get(F.filter(known, lambda c: F.array_contains(parts, c)), F.lit(0))
    return F.when(F.array_contains(known, whole), whole).otherwise(first)


def luminance(colour: Column) -> Column:
    """Relative luminance of a #rrggbb colour."""

    def part(k: int) -> Column:
        x = F.conv(F.substring(colour, k, 2), 16, 10).cast("double") / 255
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, from 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def image_kind(content: Column) -> Column:
    """png, jpg, gif, webp, ico or svg by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("00000100"), "ico").when(text.startswith("<svg") | (text.startswith("<?xml") & text.contains("<svg")), "svg")
    )
