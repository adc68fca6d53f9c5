"""Web addresses as column expressions: normal form, item id, host and a comparison key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors, besides those that start with utm_.
TRACKERS = ["fbclid", "gclid", "ref", "referrer", "mc_cid", "mc_eid"]
# Characters that stay literal in a query, with their escapes.
_LITERAL = {"%2F": "/", "%3A": ":", "%40": "@", "%21": "!", "%24": "$", "%27": "'", "%28": "(", "%29": ")", "*": "*", "%2C": ",", "%3B": ";", "%7E": "~"}
_PARTS = r"^(?i:https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _absolute(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when((u != "") & ~u.contains("://"), F.concat(F.lit("https://"), u)).otherwise(u)


def _authority(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 1)), r"^(?:[^@]*@)?", "")
    return F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www\.", "")


def _params(url: Column) -> Column:
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    keep = lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKERS)
    return F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"), keep)


def host_of(url: Column) -> Column:
    """Lower-case host without www., port and final dot; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(_authority(_absolute(url)), r":\d+$", ""), r"\.$", "")


def normalise_url(url: Column) -> Column:
    """https form without www., default port, fragment, final slash and trackers, with sorted parameters.

    Empty stays empty; other schemes and addresses without a host stay as they are; null stays null.
    """
    u = _absolute(url)
    code = lambda s: F.replace(F.url_encode(F.coalesce(F.try_url_decode(s), s)), F.lit("+"), F.lit("%20"))
    pairs = F.array_sort(F.transform(_params(u), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise("").alias("v"))))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    for escape, literal in _LITERAL.items():
        query = F.replace(query, F.lit(escape), F.lit(literal))
    path = F.regexp_replace(F.regexp_extract(u, _PARTS, 2), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    whole = F.concat(F.lit("https://"), _authority(u), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(_authority(u) != "", whole).otherwise(u)


def item_id(url: Column) -> Column:
    """First 12 hex digits of the sha1 of the normal form."""
    return F.substring(F.sha1(F.encode(normalise_url(url), "utf-8")), 1, 12)


def address_key(url: Column) -> Column:
    """Addresses with the same key lead to the same page; null where there is no web address."""
    u = _absolute(url)
    path = F.regexp_replace(F.regexp_extract(u, _PARTS, 2), "/+$", "")
    query = F.array_join(F.array_sort(_params(u)), "&")
    return F.when(_authority(u) != "", F.concat_ws("", _authority(u), path, F.when(query != "", F.concat(F.lit("?"), query))))
