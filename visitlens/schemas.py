"""Fixed table shapes. Free event payloads stay JSON text in ``data``."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_IN_BATCH = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("visitorId", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("data", T.StringType()),
])

EVENT_BATCH = T.StructType([
    T.StructField("events", T.ArrayType(EVENT_IN_BATCH)),
    T.StructField("meta", T.StructType([T.StructField("sentAt", T.LongType())])),
])

# What the web server knows of a request, stored beside each of its events.
REQUEST = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "ip_address", "country", "city", "region", "continent", "postal_code", "metro_code", "latitude",
        "longitude", "timezone", "colo")]
    + [T.StructField("asn", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in (
        "organization_identifier", "user_agent", "default_language", "referer_header", "device_type")]
    + [T.StructField("is_eu_country", T.BooleanType())]
    + [T.StructField(name, T.StringType()) for name in ("tls_version", "tls_cipher", "http_protocol", "origin")])

ENVELOPE = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("request", REQUEST),
    T.StructField("received_at", T.LongType()),
])

IDENTITY = T.StructType([
    T.StructField("shortId", T.StringType()),
    T.StructField("visitorId", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("firstName", T.StringType()),
    T.StructField("lastName", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("campaignId", T.StringType()),
    T.StructField("campaignName", T.StringType()),
    T.StructField("sequenceStep", T.IntegerType()),
    T.StructField("createdAt", T.LongType()),
    T.StructField("expiresAt", T.LongType()),
])

# Lead attributes a patch may overwrite.
LEAD_PATCH_FIELDS = [
    "first_name", "last_name", "phone", "linkedin_url", "job_title",
    "job_seniority", "job_department", "company_name", "company_website",
    "company_linkedin", "company_description", "company_headcount",
    "company_revenue", "company_industry", "company_address",
    "personal_address",
]

# The event types the event table accepts.
EVENT_TYPES = [
    "page_view", "click", "scroll_depth", "form_start", "form_submit",
    "video_play", "video_pause", "video_watched", "video_progress",
    "video_complete", "focus_lost", "focus_gained", "text_copied",
    "text_pasted", "rage_click", "page_exit", "device_switched",
    "email_submitted", "email_captured", "identify", "email_sent",
    "email_bounced", "email_replied", "email_click",
    "browser_emails_scanned",
]
