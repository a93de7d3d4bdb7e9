"""URL parts by pattern.

``parse_url`` rejects any address a strict URI parser rejects (a raw space or
``|`` in the query is enough), while browsers accept those. The patterns here
follow the browser and give null for text that is no URL at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions.scalars import bound, filled

# Campaign parameters stored with an event, and the further ones
# a page view carries.
STORED_CAMPAIGN_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid",
]
PAGE_VIEW_CAMPAIGN_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "ref", "source",
]

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)"


def is_url(url: Column) -> Column:
    """True for an absolute web address, false otherwise, never null."""
    return F.coalesce(url.rlike(r"^(?i)(https?|wss?|ftp)://[^/?#\s]+"
                                r"|^(?i)(?!(https?|wss?|ftp):)[a-z][a-z0-9+.\-]*:"), F.lit(False))


def host(url: Column) -> Column:
    return filled(F.lower(F.regexp_extract(url, _HOST, 1)))


def path(url: Column) -> Column:
    """Path part; a bare host has the path ``/``."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(is_url(url), F.when(found == "", F.lit("/")).otherwise(found))


def query_text(url: Column) -> Column:
    """Text between ``?`` and ``#``, null when absent or empty."""
    return F.when(is_url(url), filled(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)))


def decoded(text: Column) -> Column:
    """Percent and plus decoding; malformed escapes are left as they are."""
    return F.when(text.contains("%"), F.coalesce(
        F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))).otherwise(
        F.replace(text, F.lit("+"), F.lit(" ")))


def url_params(url: Column) -> Column:
    """Query parameters as a map. A repeated key keeps its last value."""
    def entry(piece: Column) -> Column:
        key = F.substring_index(piece, "=", 1)
        return F.struct(decoded(key).alias("key"),
                        decoded(F.substr(piece, F.length(key) + 2)).alias("value"))

    def last_ones(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)),
            lambda later: later["key"] == e["key"]))

    def as_map(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        once = F.size(F.array_distinct(keys)) == F.size(entries)
        return F.when(F.size(entries) > 0, F.map_from_entries(
            F.when(once, entries).otherwise(last_ones(entries))))

    pieces = F.filter(F.split(query_text(url), "&"), lambda p: p != "")
    return F.when(url.contains("?"), bound(F.transform(pieces, entry), as_map))


def param(params: Column, name: str) -> Column:
    """One parameter, with the empty string counted as absent."""
    return filled(F.try_element_at(params, F.lit(name)))


def tracking_url(base_url: str, tracking_id: Column, destination: str) -> Column:
    """Redirect link that carries a tracking id and the encoded target."""
    return F.concat(
        F.lit(base_url.rstrip("/") + "/go?i="), F.url_encode(tracking_id),
        F.lit("&to="), F.url_encode(F.lit(destination)))
