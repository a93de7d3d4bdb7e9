"""Sessions: cutting the event stream, rolling up, first touch, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import events as ev, urls
from visitlens.functions.scores import engagement_points
from visitlens.functions.scalars import filled, payload, payload_struct
from visitlens.operators.skew import (
    HOT_ROWS, Previous, RunningMax, RunningSum, along, heavy_keys, lookup)

GAP_SECONDS = 30 * 60
ORDER = ["ts", "event_id"]


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one timestamp to a later one."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("long")


def visitor_key(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``visitor_key``: one id per person also for anonymous events.

    Visitor id, else the session's first browser id (sent with few event types
    only), else the device fingerprint.
    """
    rows = events.withColumn("_p", payload_struct(
        F.col("data"), "browserId string, deviceFingerprint string"))
    browser = filled(F.col("_p.browserId"))
    # No filter on the browser id: it would parse every payload a second time.
    per_session = (rows.filter(F.col("session_id").isNotNull()).groupBy("session_id")
                   .agg(F.min_by(browser, F.when(browser.isNotNull(), F.struct(*ORDER))).alias("_browser")))
    out = lookup(rows, per_session, "session_id", "event_id", hot_rows=hot_rows)
    return (out.withColumn("visitor_key", F.coalesce(
        filled(F.col("visitor_id")), F.col("_browser"), filled(F.col("_p.deviceFingerprint"))))
        .drop("_browser", "_p"))


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS, key: str = "visitor_id",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``session_number``: a new one after more than ``gap_seconds`` idle.

    A gap of exactly the limit stays in the session. Rows without a key are
    dropped; give them one with :func:`visitor_key` first.
    """
    events = events.filter(F.col(key).isNotNull())
    hot = heavy_keys(events, [key], hot_rows)
    out = along(events, [key], ORDER, {"_before": Previous(F.col("ts"))}, hot)
    idle = F.unix_micros("ts") - F.unix_micros("_before")
    starts = F.when(idle <= F.lit(gap_seconds * 1_000_000), 0).otherwise(1)
    return along(out, [key], ORDER, {"session_number": RunningSum(starts)}, hot).drop("_before")


def _first_filled(name: str) -> Column:
    """Time, id and value of the first event that has a value."""
    value = filled(F.col(name).cast("string"))
    return F.min(F.when(value.isNotNull(), F.struct("ts", "event_id", value.alias("value"))))


#: What is said of a session's place and device by its first event that says it.
FIRST_OF_SESSION = ("country", "city", "region", "user_agent", "device_type", "platform")


def session_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable state of each session: sums, extremes, firsts and lasts with their time, a set of videos.

    States of parts of a session, put together by :func:`merge_session_states`, give the state of
    the whole. Columns of :data:`FIRST_OF_SESSION` that the table lacks count as null; the
    platform is also looked for in the payload.
    """
    def of_type(name: str) -> Column:
        return F.count_if(F.col("type") == name)

    have = [c for c in FIRST_OF_SESSION if c in events.columns]
    slim = events.select(
        *keys, "ts", "event_id", "type", "url", *have,
        payload_struct(F.col("data"), "depth double, maxScrollDepth double, activeTime double,"
                       " videoId string, src string, platform string").alias("_p")).select(
        "*", F.greatest("_p.depth", "_p.maxScrollDepth").alias("_depth"),
        F.when(F.col("type") == "page_exit", F.col("_p.activeTime")).alias("_active"),
        F.when(F.col("type") == "video_watched", F.coalesce(
            filled(F.col("_p.videoId")), filled(F.col("_p.src")))).alias("_video"))
    if "platform" not in have:
        slim = slim.withColumn("platform", F.col("_p.platform"))
    slim = slim.withColumns({c: F.lit(None).cast("string") for c in FIRST_OF_SESSION if c not in slim.columns})
    page = F.struct("ts", "event_id", "url")
    return slim.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.min(page).alias("first"), F.max(page).alias("last"),
        of_type("page_view").alias("pageviews"), of_type("click").alias("clicks"),
        F.max("_depth").alias("max_depth"), of_type("form_start").alias("forms_started"),
        of_type("form_submit").alias("forms_submitted"), F.collect_set("_video").alias("videos"),
        F.sum("_active").alias("active"), *[_first_filled(c).alias(f"first_{c}") for c in FIRST_OF_SESSION],
        F.count(F.lit(1)).alias("events"))


def merge_session_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state per session out of the states of its parts."""
    return states.groupBy(*keys).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("pageviews").alias("pageviews"), F.sum("clicks").alias("clicks"),
        F.max("max_depth").alias("max_depth"), F.sum("forms_started").alias("forms_started"),
        F.sum("forms_submitted").alias("forms_submitted"),
        F.array_distinct(F.flatten(F.collect_list("videos"))).alias("videos"), F.sum("active").alias("active"),
        *[F.min(f"first_{c}").alias(f"first_{c}") for c in FIRST_OF_SESSION], F.sum("events").alias("events"))


def finished_sessions(states: DataFrame, keys: list[str]) -> DataFrame:
    """Session rows as served, from their states.

    Device and system come from what the request or the browser says, else from the user agent.
    """
    def said(name: str) -> Column:
        return F.col(f"first_{name}.value")

    agent = ev.agent_fields(said("user_agent"))
    out = states.select(
        *keys, "start_time", "end_time", F.col("first.url").alias("first_page"), F.col("last.url").alias("last_page"),
        "pageviews", "clicks", F.coalesce("max_depth", F.lit(0)).cast("int").alias("max_scroll_depth"),
        "forms_started", "forms_submitted", F.size("videos").cast("long").alias("videos_watched"),
        F.coalesce("active", F.lit(0)).cast("long").alias("active_time"), said("country").alias("country"),
        said("city").alias("city"), said("region").alias("region"), "events",
        F.coalesce(said("device_type"), agent["device"]).alias("device"),
        F.coalesce(said("platform"), agent["operating_system"]).alias("operating_system"),
        agent["browser"].alias("browser"),
        seconds_between(F.col("start_time"), F.col("end_time")).alias("duration"))
    milestones = sum((F.when(F.col("max_scroll_depth") >= m, 1).otherwise(0)
                      for m in (25, 50, 75, 90, 100)), F.lit(0))
    return out.withColumn("engagement_score", F.round(4 * engagement_points(
        F.col("pageviews"), F.col("active_time"), milestones), 2))


def session_rollup(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session from its events (``type`` normalised).

    A click on a video emits ``video_watched`` at once and again after ten
    seconds, so videos are counted by id. Active time adds up the page exits,
    each of which covers one page load.
    """
    return finished_sessions(session_state(events, keys), keys)


def joined_session_states(states: DataFrame, key: str = "visitor_id", gap_seconds: int = GAP_SECONDS,
                          hot_rows: int = HOT_ROWS) -> DataFrame:
    """States of whole sessions out of those that any batches cut at the same gap.

    Two parts belong to one session when at most the gap lies between them, or they overlap.
    """
    hot = heavy_keys(states, [key], hot_rows)
    order = ["start_time", "_id"]
    rows = states.withColumn("_id", F.col("first.event_id"))
    rows = along(rows, [key], order, {"_until": RunningMax(F.col("end_time"), before=True)}, hot)
    idle = F.unix_micros("start_time") - F.unix_micros("_until")
    starts = F.when(idle <= F.lit(gap_seconds * 1_000_000), 0).otherwise(1)
    rows = along(rows, [key], order, {"_number": RunningSum(starts)}, hot)
    return merge_session_states(rows, [key, "_number"]).drop("_number")


def visitor_totals(events: DataFrame, key: str = "visitor_id",
                   session: str = "session_id") -> DataFrame:
    """Page views, clicks, sessions and last event per visitor, in one pass."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col("type") == "page_view").alias("total_pageviews"),
        F.count_if(F.col("type") == "click").alias("total_clicks"),
        F.count_distinct(session).alias("total_sessions"),
        F.max("ts").alias("last_seen_at"))


def first_touch(events: DataFrame, key: str = "visitor_id") -> DataFrame:
    """First page, referrer, place and campaign of each visitor.

    The time zone is the browser's, from the payload, else that of the request. Columns of the place that the
    table lacks are null.
    """
    place = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c)
             for c in ("country", "city", "region", "timezone")]
    first = (events.filter(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min_by(F.struct("ts", "url", "referrer", *place, "data"), F.struct(*ORDER)).alias("_f")))
    # Only the winning row's address is parsed.
    return first.select(key, "_f.*").withColumn("_params", urls.url_params(F.col("url"))).select(
        key, F.col("ts").alias("first_seen_at"), F.col("url").alias("first_page"),
        filled(F.col("referrer")).alias("first_referrer"), *[filled(F.col(c)).alias(c) for c in ("country", "city", "region")],
        F.coalesce(filled(payload(F.col("data"), "timezone")), filled(F.col("timezone"))).alias("timezone"),
        *[urls.param(F.col("_params"), n).alias(n) for n in urls.STORED_CAMPAIGN_PARAMS])


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per event although failed sends are repeated whole.

    Copies are combined before the shuffle, so a huge group of copies is one
    row per task when it moves.
    """
    keys = ["visitor_id", "session_id", "raw_type", "ts", "url"]
    rest = [c for c in events.columns if c not in keys]
    return (events.groupBy(*keys, F.sha2("data", 256).alias("_d"))
            .agg(F.min_by(F.struct(*rest), F.col("event_id")).alias("_r"),
                 F.count(F.lit(1)).alias("copies"))
            .select(*keys, "_r.*", "copies"))
