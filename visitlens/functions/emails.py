"""E-mail addresses: finding, checking, classing and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions.scalars import bound, email_domain, filled

# Address pattern and mailbox providers counted as personal.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PERSONAL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com",
                    "icloud.com", "aol.com"]


def normal_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def is_email(email: Column) -> Column:
    return F.trim(email).rlike(f"^{EMAIL_PATTERN}$")


def is_personal(email: Column) -> Column:
    return F.coalesce(F.lower(email_domain(email)).isin(PERSONAL_DOMAINS), F.lit(False))


def emails_in(text: Column) -> Column:
    """Distinct normalised addresses in a text of any kind.

    Three passes: the text as it stands; the text as JSON written out again,
    which undoes escapes such as ``\\u0040``; the percent-decoded text. A plus
    sign is kept by the last pass, as it may be part of an address.
    """
    def found(t: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(t, F.lit(f"({EMAIL_PATTERN})"), F.lit(1)),
                          F.array().cast("array<string>"))

    as_json = F.when(text.rlike(r"^\s*[\[{]") & text.contains("\\u"),
                     F.to_json(F.try_parse_json(text)))
    unescaped = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    # A replacement character that the text did not have means invalid UTF-8.
    unescaped = F.when(text.contains("%") & (
        ~unescaped.contains("�") | text.contains("�")), unescaped)
    every = F.concat(found(text), found(as_json), found(unescaped))
    return F.filter(F.array_distinct(F.transform(every, normal_email)), is_email)


def may_hold_email(text: Column) -> Column:
    """False when no pass of :func:`emails_in` can find anything."""
    return text.contains("@") | text.contains("%40") | text.contains("\\u0040")


def sha256_of(email: Column) -> Column:
    return F.sha2(normal_email(email), 256)


def sha1_of(email: Column) -> Column:
    return F.sha1(normal_email(email).cast("binary"))


def md5_of(email: Column) -> Column:
    return F.md5(normal_email(email).cast("binary"))


def tracking_id_for(email: Column, campaign_id: Column) -> Column:
    """Same person and campaign, same id: 8 hex digits of a SHA-256."""
    return F.substring(
        F.sha2(F.concat(normal_email(email), F.lit("-"), campaign_id), 256), 1, 8)


def scrubbed_fields(fields: Column) -> Column:
    """Form fields with every address replaced by its three hashes.

    Other values are cut to 100 characters.
    """
    def one(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        hashed = F.array(
            F.struct(F.concat(key, F.lit("_sha256")).alias("key"), sha256_of(value).alias("value")),
            F.struct(F.concat(key, F.lit("_sha1")).alias("key"), sha1_of(value).alias("value")),
            F.struct(F.concat(key, F.lit("_md5")).alias("key"), md5_of(value).alias("value")))
        plain = F.array(F.struct(key.alias("key"), F.substring(value, 1, 100).alias("value")))
        return F.when(holds_email(key, value), hashed).otherwise(plain)

    def last_ones(entries: Column) -> Column:
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.greatest(F.size(entries), F.lit(1))),
            lambda later: later["key"] == e["key"])))

    return bound(F.flatten(F.transform(F.map_entries(fields), one)), last_ones)


def holds_email(key: Column, value: Column) -> Column:
    return F.lower(key).contains("email") & F.coalesce(value.contains("@"), F.lit(False))


def form_email(fields: Column) -> Column:
    """Address of the last e-mail field of a form, null without one."""
    hits = F.filter(F.map_entries(fields), lambda e: holds_email(e["key"], e["value"]))
    return F.get(hits, F.size(hits) - 1)["value"]


def contact_email(work: Column, personal: Column) -> Column:
    return F.coalesce(filled(work), filled(personal))
