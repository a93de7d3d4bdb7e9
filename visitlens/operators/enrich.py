"""Event projections, filters and row tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.functions import emails, events as ev, urls
from visitlens.functions.scalars import as_ts, email_domain, filled, payload


def typed(df: DataFrame, raw: str = "raw_type") -> DataFrame:
    """Add the normalised ``type`` and its ``category``."""
    kind = ev.normal_type(F.col(raw))
    return df.withColumns({"type": kind, "category": ev.category_of(kind)})


def unknown_event_types(df: DataFrame) -> DataFrame:
    """Events the event table would refuse. ``type`` must be normalised."""
    return df.filter(~F.coalesce(F.col("type").isin(schemas.EVENT_TYPES), F.lit(False)))


def enrich_events(df: DataFrame) -> DataFrame:
    """Events in store form. A bad address keeps its row, flagged ``url_ok``.

    Expects raw events with ``raw_type, url, referrer, data, ip_address,
    session_id, ts``; other columns pass through. ``data`` gains the original
    session id, which the store's own session key replaces.
    """
    # The map is a column of its own, so each address is parsed once.
    out = typed(df).withColumns({"url_ok": urls.is_url(F.col("url")),
                                 "_params": urls.url_params(F.col("url"))})
    # Adding one field to JSON text is a splice; no need to parse the payload.
    text = F.trim(F.coalesce("data", F.lit("{}")))
    inside = F.trim(F.substr(text, F.lit(2), F.length(text) - 2))
    session = F.to_json(F.struct(F.col("session_id").alias("s")))
    field = F.concat(F.lit('"_originalSessionId":'), F.substr(session, F.lit(6)))
    spliced = F.when(F.col("session_id").isNull() | ~text.startswith("{"), F.col("data")).when(
        inside == "", F.concat(F.lit("{"), field)).otherwise(
        F.concat(F.lit("{"), inside, F.lit(","), field))
    columns = {
        "path": urls.path(F.col("url")),
        "company_identifier": ev.company_identifier(F.col("ip_address")),
        "url_parms": F.to_json("_params"),
        "campaign_id": ev.valid_uuid(payload(F.col("data"), "campaign_id")),
        "message_id": ev.valid_uuid(payload(F.col("data"), "message_id")),
        "data": spliced,
    }
    for name in urls.STORED_CAMPAIGN_PARAMS:
        columns[name] = urls.param(F.col("_params"), name)
    return out.withColumns(columns).drop("_params")


def url_params(df: DataFrame) -> DataFrame:
    """Query parameters of every event, one row per key."""
    return (df.select("event_id", urls.url_params(F.col("url")).alias("p"))
            .select("event_id", F.explode("p").alias("param", "value")))


def utm_fields(df: DataFrame) -> DataFrame:
    """Campaign parameters a page view carries, and whether it has any."""
    out = df.withColumn("_params", urls.url_params(F.col("url"))).select(
        "event_id", *[urls.param(F.col("_params"), n).alias(n) for n in urls.PAGE_VIEW_CAMPAIGN_PARAMS])
    return out.withColumn("has_utm", F.coalesce(
        *[F.col(n) for n in urls.PAGE_VIEW_CAMPAIGN_PARAMS]).isNotNull())


def identity_from_url(df: DataFrame, parameter: str = "i") -> DataFrame:
    """Tracking id carried in the address.

    It also becomes the visitor id of the event; the browser keeps it for later
    events itself.
    """
    found = urls.param(urls.url_params(F.col("url")), parameter)
    return df.withColumns({"url_tracking_id": found,
                           "visitor_id": F.coalesce(found, F.col("visitor_id"))})


def email_submitted_events(df: DataFrame) -> DataFrame:
    """One derived event for every form submission with an address."""
    return (df.filter((F.col("type") == "form_submit") & payload(F.col("data"), "email").contains("@"))
            .withColumn("type", F.lit("email_submitted"))
            .withColumn("previously_anonymous", F.col("visitor_id").isNull()))


def owner_check(df: DataFrame, visitor: str = "web_visitor_id",
                lead: str = "lead_id") -> tuple[DataFrame, DataFrame]:
    """Split rows by "exactly one owner". Empty text counts as no owner."""
    one = filled(F.col(visitor)).isNull() != filled(F.col(lead)).isNull()
    return df.filter(one), df.filter(~one)


def default_channel(df: DataFrame) -> DataFrame:
    return df.withColumn("channel", ev.channel(F.col("referrer"), F.col("url")))


def local_time_features(df: DataFrame, zone: Column) -> DataFrame:
    return df.withColumns(ev.local_time(F.col("ts"), zone))


def page_intent_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(ev.page_flags(F.col("type"), F.col("url")))


def company_identifier(df: DataFrame) -> DataFrame:
    return df.withColumn("company_identifier", ev.company_identifier(F.col("ip_address")))


def valid_uuid_fk(df: DataFrame, fields: tuple[str, ...] = ("campaign_id", "message_id")) -> DataFrame:
    return df.withColumns({f: ev.valid_uuid(payload(F.col("data"), f)) for f in fields})


def name_fallback(df: DataFrame) -> DataFrame:
    """First and last name, else the words of the full name."""
    words = F.split(F.coalesce("person_name", F.lit("")), " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
    return df.withColumns({
        "first_name": F.coalesce(filled(F.col("first_name")), filled(F.get(words, 0))),
        "last_name": F.coalesce(filled(F.col("last_name")), filled(rest)),
    })


def split_work_personal_email(df: DataFrame, email: str = "email") -> DataFrame:
    personal = emails.is_personal(F.col(email))
    return df.withColumns({
        "personal_email": F.when(personal, F.col(email)),
        "work_email": F.when(~personal, filled(F.col(email))),
    })


def lead_profile_fields(leads: DataFrame) -> DataFrame:
    """Lead columns as served. Whatever is missing is null."""
    contact = emails.contact_email(F.col("work_email"), F.col("personal_email"))
    both = filled(F.col("first_name")).isNotNull() & filled(F.col("last_name")).isNotNull()
    return leads.withColumns({
        "email": contact,
        "person_name": F.when(both, F.concat_ws(" ", "first_name", "last_name")),
        "domain": F.coalesce(filled(F.col("company_website")), filled(email_domain(contact))),
        "first_name": filled(F.col("first_name")),
        "last_name": filled(F.col("last_name")),
        "company": F.col("company_name"),
    })


def scrub_form_fields(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Form submissions without addresses in clear.

    Adds the scrubbed map, the field list, whether an address was given, its
    hash and its domain.
    """
    m = F.col(fields)
    address = emails.form_email(m)
    clean = emails.scrubbed_fields(m)
    return df.withColumns({
        "clean_fields": clean,
        "field_names": F.map_keys(clean),
        "has_email": address.isNotNull(),
        "email_hash": emails.sha256_of(address),
        "email_domain": email_domain(address),
    }).drop(fields)


def extract_emails(texts: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """Addresses in a text column: ``source, row_id, email``, one row each.

    Every address has an ``@``, plain or escaped; other texts need no search.
    """
    return texts.filter(emails.may_hold_email(F.col(text))).select(
        F.lit(source).alias("source"), F.col(id_col).cast("string").alias("row_id"),
        F.explode(emails.emails_in(F.col(text))).alias("email"))


def hash_emails(found: DataFrame) -> DataFrame:
    """One row per address: hashes, domain, sources; never the address.

    ``sources`` names the scanned columns, so its length is the number of
    columns scanned however often an address occurs.
    """
    return (found.withColumn("email", emails.normal_email(F.col("email")))
            .filter(emails.is_email(F.col("email")))
            .groupBy("email", "source").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("email").agg(F.sum("n").alias("occurrences"),
                                  F.sort_array(F.collect_list("source")).alias("sources"))
            .select(emails.sha256_of(F.col("email")).alias("sha256"),
                    emails.sha1_of(F.col("email")).alias("sha1"),
                    emails.md5_of(F.col("email")).alias("md5"),
                    email_domain(F.col("email")).alias("email_domain"),
                    "occurrences", "sources"))


def extract_video_id(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("video_id", ev.video_id(F.col(url)))


def device_fingerprint(df: DataFrame) -> DataFrame:
    """Fingerprint from the browser description columns of an event table."""
    names = ["user_agent", "language", "screen_width", "screen_height", "color_depth",
             "timezone_offset", "has_session_storage", "has_local_storage", "platform"]
    return df.withColumn("device_fingerprint", ev.fingerprint(*[F.col(n) for n in names]))


def map_email_status(results: DataFrame) -> DataFrame:
    """Verification result to lead status, each row by its own result."""
    # Result names and the status each gives.
    names = {"valid": "verified", "invalid": "invalid", "catch-all": "accept_all"}
    out = None
    for result, status in names.items():
        test = F.col("status") == result
        out = F.when(test, status) if out is None else out.when(test, status)
    return results.withColumn("email_status", out.otherwise("unverified"))


def unexpired_only(df: DataFrame, as_of, column: str = "expires_at") -> DataFrame:
    return df.filter(F.col(column) > as_ts(as_of))


def retention_filter(df: DataFrame, as_of, days: int = 730, date: str = "event_date") -> DataFrame:
    """Drop events past retention. On a table by day this prunes partitions."""
    oldest = F.date_sub(F.to_date(as_ts(as_of)), days)
    return df.filter(F.col(date) >= oldest)


def origin_allowlist(df: DataFrame, allowed: list[str], origin: str = "origin") -> DataFrame:
    """Rows from an allowed origin. ``*`` stands for any text; dots are dots."""
    # Site-editor preview hosts that always pass.
    test = F.col(origin).contains(".canvas.webflow.com") | F.col(origin).contains(".preview.webflow.com")
    for pattern in (p.strip() for p in allowed):
        if "*" in pattern:
            parts = ["\\Q" + p + "\\E" if p else "" for p in pattern.split("*")]
            test = test | F.col(origin).rlike("^" + ".*".join(parts) + "$")
        else:
            test = test | (F.col(origin) == pattern)
    return df.filter(test)
