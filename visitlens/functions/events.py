"""Event classing, traffic source, local time and page flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions import urls
from visitlens.functions.scalars import filled, hash32

# Old type names and the event categories.
RENAMED_TYPES = {"email_identified": "email_captured", "pageview": "page_view"}
EMAIL_TYPES = ["email_sent", "email_bounced", "email_replied", "email_click"]
SYSTEM_TYPES = ["email_captured", "identify", "browser_emails_scanned"]

# Referrer hosts and the channel each stands for, in rule order.
# The last two columns say whether the mark is matched anywhere in the host or
# only as whole host labels.
CHANNELS = [
    ("google.", "organic_search_google", False),
    ("bing.", "organic_search_bing", False),
    ("yahoo.", "organic_search_yahoo", False),
    ("duckduckgo.", "organic_search_duckduckgo", False),
    ("facebook.", "social_facebook", False),
    ("fb", "social_facebook", True),
    ("linkedin.", "social_linkedin", False),
    ("twitter.", "social_twitter", False),
    ("t.co", "social_twitter", True),
    ("instagram.", "social_instagram", False),
]

# Fixed value: the form of a UUID.
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def normal_type(raw: Column) -> Column:
    out = raw
    for old, new in RENAMED_TYPES.items():
        out = F.when(raw == old, F.lit(new)).otherwise(out)
    return out


def category_of(event_type: Column) -> Column:
    """Category of an already normalised type."""
    return (F.when(event_type.isin(EMAIL_TYPES), "email")
            .when(event_type.isin(SYSTEM_TYPES), "system")
            .otherwise("website"))


def company_identifier(ip: Column) -> Column:
    """Hash of the first two dotted parts of an address."""
    ip = filled(ip)
    return F.when(ip.isNotNull(), hash32(F.substring_index(ip, ".", 2)))


def valid_uuid(text: Column) -> Column:
    return F.when(text.rlike(UUID_PATTERN), text)


def channel(referrer: Column, page_url: Column) -> Column:
    """Traffic source of a visit that carries no campaign parameters.

    The short marks ``fb`` and ``t.co`` match whole host labels only; a plain
    substring test would class pinterest.com as a t.co link.
    """
    domain = urls.host(referrer)
    out = F.when(filled(referrer).isNull(), F.lit("direct"))
    for mark, name, labels in CHANNELS:
        if not labels:
            hit = domain.contains(mark)
        elif "." in mark:
            hit = F.concat(F.lit("."), domain).endswith("." + mark)
        else:
            hit = F.concat(F.lit("."), domain).contains(f".{mark}.")
        out = out.when(hit, F.lit(name))
    return (out.when(domain == urls.host(page_url), F.lit("internal"))
            .when(domain.isNotNull(), F.concat(F.lit("referral_"), domain)))


def local_time(ts: Column, zone: Column) -> dict[str, Column]:
    """Hour, weekday (0 = Sunday), weekend and office-hours flags in a zone."""
    local = F.from_utc_timestamp(ts, zone)
    hour = F.hour(local)
    weekday = F.dayofweek(local) - 1
    return {
        "local_hour": hour,
        "local_weekday": weekday,
        "is_weekend": weekday.isin(0, 6),
        "is_business_hours": weekday.between(1, 5) & (hour >= 9) & (hour < 17),
    }


def page_flags(event_type: Column, url: Column) -> dict[str, Column]:
    """Intent marks of one event."""
    # The page addresses that say intent.
    return {
        "viewed_pricing": F.coalesce(url.contains("/pricing"), F.lit(False)),
        "requested_demo": F.coalesce(url.contains("/demo"), F.lit(False)),
        "submitted_form": F.coalesce(event_type == "form_submit", F.lit(False)),
        "viewed_case_study": F.coalesce(url.contains("/case-stud"), F.lit(False)),
        "viewed_product": F.coalesce(url.contains("/product"), F.lit(False)),
    }


def video_id(url: Column) -> Column:
    """Video id in a player address, null when there is none."""
    # The address forms, tried in this order.
    patterns = [
        r"(?:youtube\.com/embed/|youtu\.be/|youtube-nocookie\.com/embed/)([^?&/]+)",
        r"[?&]v=([^?&]+)",
        r"youtube\.com/watch\?.*v=([^&]+)",
    ]
    return F.coalesce(*[filled(F.regexp_extract(url, p, 1)) for p in patterns])


def fingerprint(user_agent: Column, language: Column, width: Column, height: Column,
                color_depth: Column, tz_offset: Column, session_storage: Column,
                local_storage: Column, platform: Column) -> Column:
    """Device fingerprint from the browser's own description of itself."""
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return hash32(F.concat_ws(
        "|", text(user_agent), text(language),
        F.concat(text(width), F.lit("x"), text(height)), text(color_depth),
        text(tz_offset), text(session_storage), text(local_storage), text(platform)))


# Marks in a user agent and what each stands for, in rule order: later marks are
# also carried by agents that an earlier one names.
BROWSER_MARKS = [("Edg/", "Edge"), ("OPR/", "Opera"), ("SamsungBrowser/", "Samsung Internet"), ("CriOS/", "Chrome"),
                 ("FxiOS/", "Firefox"), ("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Safari/", "Safari")]
SYSTEM_MARKS = [("Windows", "Windows"), ("iPhone", "iOS"), ("iPad", "iOS"), ("iPod", "iOS"), ("Android", "Android"),
                ("CrOS", "ChromeOS"), ("Mac OS X", "macOS"), ("Macintosh", "macOS"), ("Linux", "Linux")]
BOT_MARKS = ["bot", "crawl", "spider"]
TABLET_MARKS = ["iPad", "Tablet", "Kindle"]
MOBILE_MARKS = ["Mobi", "iPhone", "iPod"]


def agent_fields(user_agent: Column) -> dict[str, Column]:
    """Browser, operating system and device of a user agent; null without one.

    An Android agent that doesn't call itself mobile is a tablet's.
    """
    def by_rule(marks: list[tuple[str, str]]) -> Column:
        out = F.when(filled(user_agent).isNull(), F.lit(None).cast("string"))
        for mark, name in marks:
            out = out.when(user_agent.contains(mark), F.lit(name))
        return out.otherwise(F.lit("Other"))

    def any_of(text: Column, marks: list[str]) -> Column:
        test = text.contains(marks[0])
        for mark in marks[1:]:
            test = test | text.contains(mark)
        return test

    mobile = any_of(user_agent, MOBILE_MARKS)
    device = (F.when(filled(user_agent).isNull(), F.lit(None).cast("string"))
              .when(any_of(F.lower(user_agent), BOT_MARKS), "bot")
              .when(any_of(user_agent, TABLET_MARKS) | (user_agent.contains("Android") & ~mobile), "tablet")
              .when(mobile, "mobile").otherwise("desktop"))
    return {"browser": by_rule(BROWSER_MARKS), "operating_system": by_rule(SYSTEM_MARKS), "device": device}
