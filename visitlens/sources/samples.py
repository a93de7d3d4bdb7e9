"""Tracking tables derived from the sample star-schema tables.

Each table is one ``SELECT`` list over a sample table, kept as SQL text that
Spark and an ANSI engine read alike. So a check query in another engine starts
from exactly the rows the Spark jobs see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.scalars import as_ts

AS_OF = "2024-01-31 00:00:00"
SITE = "https://www.example.com"


def _s(expr: str) -> str:
    return f"cast({expr} as varchar(20))"


K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

# Events, with k from the sample payload spreading rows over all variants.
EVENTS: dict[str, str] = {
    "event_id": "event_id",
    "ts": "cast(ts as timestamp)",
    "user_id": "user_id",
    "k": "k",
    "batch_id": f"'b' || {_s('user_id')} || '-' || {_s('event_id - event_id % 300')}",
    "pos": "cast(event_id % 300 as int)",
    "visitor_id": f"case when k % 25 <> 7 then 'v' || {_s('user_id')} end",
    "session_id": f"'s' || {_s('user_id')} || '-' || {_s('cast(ts as date)')}",
    "raw_type": """case event_type
        when 'view' then case when k % 4 = 3 then 'scroll_depth' else 'pageview' end
        when 'click' then case when k % 10 = 9 then 'email_click' else 'click' end
        when 'purchase' then case when k % 3 = 2 then 'form_start' else 'form_submit' end
        when 'signup' then case when k % 3 = 0 then 'email_identified'
            when k % 3 = 1 then 'video_watched' else 'video_complete' end
        else case when k = 99 then 'key_press' when k % 3 = 0 then 'focus_lost'
            when k % 3 = 1 then 'focus_gained' else 'page_exit' end end""",
    "url": f"""'{SITE}' || case k % 10 when 0 then '/pricing/' when 1 then '/demo'
        when 2 then '/case-studies/a' when 3 then '/product/x'
        else '/page/' || {_s('k % 20')} end || case k % 3 when 0 then ''
        when 1 then '?utm_source=src' || {_s('k % 4')} || '&utm_medium=&utm_source=last'
        else '?utm_campaign=c' || {_s('k % 5')} || '&q=a%20b' end""",
    "path": f"""case k % 10 when 0 then '/pricing/' when 1 then '/demo'
        when 2 then '/case-studies/a' when 3 then '/product/x'
        else '/page/' || {_s('k % 20')} end""",
    "referrer": f"""case k % 6 when 1 then 'https://www.google.com/search?q=x'
        when 2 then 'https://www.linkedin.com/feed' when 3 then 'https://www.pinterest.com/a'
        when 4 then '{SITE}/page/1' when 5 then 'https://blog.partner.org/post' end""",
    "ip_address": f"'10.' || {_s('user_id % 25')} || '.0.' || {_s('user_id % 250')}",
    "device_fingerprint": f"'d' || {_s('user_id * 3 + k % 2')}",
    "browser_id": f"""case when k % 4 <> 3 then
        'w' || {_s('user_id - user_id % 5 + (user_id % 5 + k % 2) % 5')} end""",
    "tracking_id": f"case when k % 8 = 1 then 'v' || {_s('user_id')} end",
    "email": f"""case when k % 16 in (3, 5) then
        'customer.' || lpad({_s('user_id')}, 9, '0') ||
        case when user_id % 4 = 0 then '@gmail.com' else '@corp.com' end end""",
    "depth": "(k * 5) % 101",
    "scroll_px": "(k * 53) % 1500",
    "active_s": "k % 60",
    "reading_s": "k % 37",
    "scanning_s": "k % 11",
    "video": f"'vid' || {_s('k % 3')}",
    "position_s": "k",
    "duration_s": "10 + (user_id % 9) * 10",
    "country": f"case when k % 9 <> 0 then 'C' || {_s('user_id % 7')} end",
    "city": f"case when k % 7 <> 0 then 'City ' || {_s('user_id % 50')} else '' end",
    "region": f"case when k % 5 <> 0 then 'Region ' || {_s('user_id % 12')} end",
    "timezone": "case user_id % 3 when 0 then 'Europe/Paris' when 1 then 'America/New_York' end",
    "device_type": "case user_id % 8 when 0 then 'mobile' when 1 then '' end",
    "user_agent": """case user_id % 4 when 0 then 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36'
        when 1 then 'Mozilla/5.0 (Macintosh) Version/17.0 Safari/605.1'
        when 2 then 'Mozilla/5.0 (X11; Linux) Firefox/121.0' else null end""",
}

# What the web server adds to a batch; a batch is one user's.
REQUEST: dict[str, str] = {
    "ip_address": EVENTS["ip_address"],
    "country": f"case when user_id % 9 <> 0 then 'C' || {_s('user_id % 7')} end",
    "city": f"case when user_id % 5 <> 0 then 'City ' || {_s('user_id % 50')} end",
    "region": f"'Region ' || {_s('user_id % 12')}",
    "continent": "case when user_id % 7 < 4 then 'EU' else 'NA' end",
    "postal_code": f"lpad({_s('user_id % 100000')}, 5, '0')",
    "metro_code": f"case when user_id % 7 >= 4 then {_s('500 + user_id % 90')} end",
    "latitude": f"{_s('user_id % 90')} || '.25'",
    "longitude": f"'-' || {_s('user_id % 180')} || '.5'",
    "timezone": "case user_id % 3 when 0 then 'Europe/Paris' when 1 then 'America/New_York' end",
    "colo": f"'P' || {_s('user_id % 20')}",
    "asn": "cast(64500 + user_id % 30 as bigint)",
    "organization_identifier": f"'Net ' || {_s('user_id % 30')}",
    "user_agent": EVENTS["user_agent"],
    "default_language": "case when user_id % 2 = 0 then 'en-US,en;q=0.9' else 'fr' end",
    "referer_header": f"'{SITE}/'",
    "device_type": "case user_id % 4 when 0 then 'desktop' when 1 then 'mobile' when 2 then '' end",
    "is_eu_country": "user_id % 7 < 4",
    "tls_version": "'TLSv1.3'",
    "tls_cipher": "case when user_id % 2 = 0 then 'AEAD-AES128-GCM-SHA256' else 'AEAD-AES256-GCM-SHA384' end",
    "http_protocol": "case when user_id % 6 = 5 then 'HTTP/3' else 'HTTP/2' end",
    "origin": f"'{SITE}'",
}

# Payload text of an event, built from the columns above, for check queries.
DATA = f"""'{{"depth":' || {_s('depth')} || ',"scrollTop":' || {_s('scroll_px')}
    || ',"activeTime":' || {_s('active_s')} || ',"readingTime":' || {_s('reading_s')}
    || ',"scanningTime":' || {_s('scanning_s')} || ',"totalTime":' || {_s('active_s + 30')}
    || ',"videoId":"' || video || '","currentTime":' || {_s('position_s')}
    || ',"duration":' || {_s('duration_s')}
    || coalesce(',"tracking_id":"' || tracking_id || '"', '')
    || coalesce(',"browserId":"' || browser_id || '"', '')
    || coalesce(',"email":"' || email || '"', '')
    || ',"deviceFingerprint":"' || device_fingerprint || '"}}'"""

_LEAD_TIME = ("cast('2024-01-' || lpad(" + _s("1 + c_custkey % 30") + ", 2, '0') || ' ' || lpad("
              + _s("c_custkey % 24") + ", 2, '0') || ':' || lpad(" + _s("c_custkey % 60")
              + ", 2, '0') || ':00' as timestamp)")
_EMAIL_NAME = "lower(replace(c_name, '#', '.'))"

LEADS: dict[str, str] = {
    "lead_id": f"'L' || {_s('c_custkey')}",
    "tracking_id": f"""case when c_custkey % 50 = 49 then null when c_custkey % 50 = 48 then ''
        else 'v' || {_s('c_custkey')} end""",
    "first_name": f"case when c_custkey % 3 <> 0 then 'F' || {_s('c_custkey')} else '' end",
    "last_name": f"case when c_custkey % 5 <> 0 then 'N' || {_s('c_custkey')} end",
    "person_name": f"""case when c_custkey % 7 <> 0 then
        'F' || {_s('c_custkey')} || ' van N' || {_s('c_custkey')} end""",
    "work_email": f"case when c_custkey % 4 <> 0 then {_EMAIL_NAME} || '@corp.com' else '' end",
    "personal_email": f"case when c_custkey % 4 = 0 then {_EMAIL_NAME} || '@gmail.com' end",
    "company_name": f"'Company ' || {_s('c_nationkey')}",
    "company_website": f"""case when c_custkey % 6 = 0 then
        'corp' || {_s('c_nationkey')} || '.com' end""",
    "phone": f"'+1 555 ' || lpad({_s('c_custkey % 10000')}, 4, '0')",
    "linkedin_url": f"case when c_custkey % 3 = 0 then 'https://linkedin.com/in/' || {_s('c_custkey')} end",
    "company_linkedin": f"case when c_custkey % 8 <> 0 then 'https://linkedin.com/company/' || {_s('c_nationkey')} else '' end",
    "company_description": "case when c_custkey % 11 <> 0 then 'Works in ' || c_mktsegment end",
    "company_headcount": f"case when c_custkey % 13 <> 0 then {_s('1 + c_custkey % 900')} end",
    "job_seniority": "case c_custkey % 3 when 0 then 'Senior' when 1 then '' end",
    "job_department": "case when c_custkey % 4 = 1 then 'Sales' end",
    "company_industry": "c_mktsegment",
    "company_revenue": f"{_s('cast(floor(c_acctbal) as bigint)')}",
    "job_title": "case when c_custkey % 2 = 0 then 'Manager' else '' end",
    "email_status": """case c_custkey % 4 when 0 then 'unverified' when 1 then 'verified'
        when 2 then 'invalid' else 'unverified' end""",
    "created_at": _LEAD_TIME,
    "updated_at": _LEAD_TIME,
}

MEMBERS: dict[str, str] = {
    "member_id": "o_orderkey",
    "tracking_id": f"'v' || {_s('o_custkey')}",
    "campaign_id": "o_orderpriority",
    "campaign_name": "'Campaign ' || o_orderpriority",
    "status": "o_orderstatus",
    "added_at": "cast(o_orderdate as timestamp)",
}

VALIDATIONS: dict[str, str] = {
    "email": f"""upper({_EMAIL_NAME}) ||
        case when c_custkey % 4 = 0 then '@gmail.com ' else '@corp.com ' end""",
    "status": """case c_custkey % 5 when 0 then 'valid' when 1 then 'invalid'
        when 2 then 'catch-all' when 3 then 'unknown' else 'spamtrap' end""",
}

# Visitor snapshot as it stood before the cut; one row per user seen by then.
CUT = "2024-01-02 00:00:00"
VISITORS: dict[str, str] = {
    "visitor_id": f"'v' || {_s('user_id')}",
    "device_fingerprint": f"'d' || {_s('user_id * 3')}",
    "browser_id": "cast(null as varchar(20))",
    "first_seen_at": "cast(min(ts) as timestamp)",
    "last_seen_at": "cast(max(ts) as timestamp)",
    "is_identified": "user_id % 3 = 0",
    "lead_id": f"""case when user_id % 3 = 0 then
        'L' || {_s('case when user_id % 6 = 0 then -1 else user_id end')} end""",
    "identified_at": "cast(case when user_id % 3 = 0 then max(ts) end as timestamp)",
    "total_sessions": "count(distinct cast(ts as date))",
    "total_pageviews": "sum(case when event_type = 'view' then 1 else 0 end)",
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tracking_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the pixel sends them, one row each, payload as JSON text."""
    base = raw(spark, folder, "events").selectExpr("*", f"{K} as k")
    wide = _select(base, EVENTS)
    # The same text as the check queries build; null fields are left out.
    fields = {"depth": "depth", "scrollTop": "scroll_px", "activeTime": "active_s",
              "readingTime": "reading_s", "scanningTime": "scanning_s",
              "totalTime": "active_s + 30", "videoId": "video", "currentTime": "position_s",
              "duration": "duration_s", "tracking_id": "tracking_id", "browserId": "browser_id",
              "email": "email", "deviceFingerprint": "device_fingerprint"}
    data = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]))
    return wide.withColumn("data", data).select(
        "event_id", "ts", "batch_id", "pos", "visitor_id", "session_id", "raw_type", "url",
        "referrer", "ip_address", "country", "city", "region", "timezone", "device_type", "user_agent", "data")


def event_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Request bodies: up to 300 events each, some of them malformed."""
    ev = tracking_events(spark, folder)

    def quoted(c: str):
        return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))

    one = F.concat(
        F.lit('{"type":'), quoted("raw_type"), F.lit(',"timestamp":'),
        F.unix_millis("ts").cast("string"), F.lit(',"sessionId":'), quoted("session_id"),
        F.lit(',"visitorId":'), quoted("visitor_id"), F.lit(',"url":'), quoted("url"),
        F.lit(',"referrer":'), quoted("referrer"), F.lit(',"data":'), F.col("data"), F.lit("}"))
    # A batch id covers 300 event ids, so the list cannot exceed 300 entries.
    return (ev.withColumn("e", one).groupBy("batch_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("es"),
                 (F.max(F.unix_millis("ts")) + 1000).alias("sent"))
            .select("batch_id", F.when(
                F.substring_index("batch_id", "-", 1).endswith("9")
                & F.col("batch_id").endswith("300"),
                F.lit('{"events":"none","meta":{}}')).otherwise(F.concat(
                    F.lit('{"events":['), F.array_join(F.transform("es", lambda x: x["e"]), ","),
                    F.lit('],"meta":{"sentAt":'), F.col("sent").cast("string"), F.lit("}}")))
                .alias("body")))


def request_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies with what the web server knows of each request."""
    user = F.regexp_extract("batch_id", "b([0-9]+)-", 1).cast("long")
    request = F.struct(*[F.expr(e).alias(n) for n, e in REQUEST.items()])
    sent = F.get_json_object("body", "$.meta.sentAt").cast("long")
    return event_envelopes(spark, folder).withColumn("user_id", user).select(
        "batch_id", "body", request.alias("request"),
        F.timestamp_millis(F.coalesce(sent, F.lit(0)) + 50).alias("received_at"))


def leads(spark: SparkSession, folder: str) -> DataFrame:
    return _select(raw(spark, folder, "customer"), LEADS)


def campaign_members(spark: SparkSession, folder: str) -> DataFrame:
    return _select(raw(spark, folder, "orders"), MEMBERS)


def email_validations(spark: SparkSession, folder: str) -> DataFrame:
    return _select(raw(spark, folder, "customer"), VALIDATIONS)


def web_visitors(spark: SparkSession, folder: str) -> DataFrame:
    """Visitor snapshot as of :data:`CUT`."""
    ev = raw(spark, folder, "events").filter(F.col("ts").cast("timestamp") < as_ts(CUT))
    aggregated = {k: v for k, v in VISITORS.items()
                  if k in ("first_seen_at", "last_seen_at", "identified_at",
                           "total_sessions", "total_pageviews")}
    grouped = ev.groupBy("user_id").agg(*[F.expr(e).alias(n) for n, e in aggregated.items()])
    rest = {k: (k if k in aggregated else v) for k, v in VISITORS.items()}
    return _select(grouped, rest)


def _sql(source: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {source}"


# The same tables as common table expressions for a check query.
CHECK_TABLES = {
    "te0": _sql(f"(select *, {K} as k from events)", EVENTS),
    "te1": f"select *, {DATA} as data from te0",
    "te": """select *, case raw_type when 'email_identified' then 'email_captured'
        when 'pageview' then 'page_view' else raw_type end as type from te1""",
    "leads": _sql("customer", LEADS),
    "members": _sql("orders", MEMBERS),
    "validations": _sql("customer", VALIDATIONS),
    "visitors": _sql(f"events where ts < timestamp '{CUT}' group by user_id", VISITORS),
}


def check_sql(body: str) -> str:
    """Prefix a check query with the derived tables."""
    ctes = [f"{n} as ({sql})" for n, sql in CHECK_TABLES.items()]
    body = body.strip()
    recursive = ""
    if body.lower().startswith("with recursive "):
        recursive, body = "recursive ", "with " + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return f"with {recursive}{', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
