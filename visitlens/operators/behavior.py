"""Behaviour along a session or a visitor's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.scalars import payload, payload_number
from visitlens.operators.sessions import ORDER
from visitlens.operators.skew import (
    HOT_ROWS, Following, Hot, Previous, RunningMax, RunningSum, Trailing, along, heavy_keys)

# Length of the page history, scroll and video marks, click rule.
HISTORY_PAGES = 20
SCROLL_MARKS = [25, 50, 75, 90, 100]
VIDEO_MARKS = [25, 50, 75]
RAGE_CLICKS = 5
RAGE_MILLIS = 2000
READING_PIXELS = 50
SCANNING_PIXELS = 300

CHUNK = 10_000
CHUNKS_PER_BLOCK = 1_000


def page_views(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "page_view")


def visit_number(events: DataFrame, key: str = "browser_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordinal of each page view of a browser, first-visit and return flags."""
    views = page_views(events).filter(F.col(key).isNotNull())
    hot = heavy_keys(views, [key], hot_rows)
    out = along(views, [key], ORDER, {"visit_number": RunningSum(F.lit(1))}, hot)
    return out.withColumns({"is_first_visit": F.col("visit_number") == 1,
                            "is_return_visitor": F.col("visit_number") > 1})


def page_path(events: DataFrame, key: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per page view: the page before it, and whether the visitor came back.

    Coming back means the page is among the last 20 of the session and is not
    the one just left.
    """
    views = page_views(events).filter(F.col(key).isNotNull() & F.col("path").isNotNull())
    hot = heavy_keys(views, [key], hot_rows)
    path = F.col("path")
    out = along(views, [key], ORDER, {
        "previous_page": Previous(path), "_history": Trailing(path, HISTORY_PAGES)}, hot)
    back = F.array_contains("_history", path) & (F.col("previous_page") != path)
    return out.withColumn("is_backtracking", F.coalesce(back, F.lit(False))).drop("_history")


def backtracking_visitors(views: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Number and share of page views on which a visitor came back."""
    return (views.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("pageviews"),
                 F.count_if("is_backtracking").alias("backtracks"))
            .filter("backtracks > 0")
            .withColumn("backtrack_share", F.round(F.col("backtracks") / F.col("pageviews"), 4)))


def device_history(events: DataFrame, key: str = "visitor_id", device: str = "device_fingerprint",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """A visitor's devices in the order first seen, one row per device."""
    known = events.filter(F.col(key).isNotNull() & F.col(device).isNotNull())
    return _devices(known, key, device, heavy_keys(known, [key], hot_rows))


def _devices(known: DataFrame, key: str, device: str, hot: Hot | None) -> DataFrame:
    firsts = (known.groupBy(key, device).agg(F.min(F.struct(*ORDER)).alias("_f"))
              .select(key, device, "_f.ts", "_f.event_id"))
    return along(firsts, [key], ORDER, {"device_no": RunningSum(F.lit(1))}, hot)


def device_switches(events: DataFrame, key: str = "visitor_id",
                    device: str = "device_fingerprint", hot_rows: int = HOT_ROWS) -> DataFrame:
    """First event on each further device of a visitor, one row per device.

    The devices before it are the rows of :func:`device_history` with a lower
    ``device_no``; they stay rows, as their number has no bound.
    """
    history = device_history(events, key, device, hot_rows)
    return (history.filter("device_no > 1")
            .select(key, "event_id", "ts", "device_no",
                    (F.col("device_no") - 1).alias("previous_device_count"),
                    F.col(device).alias("new_device")))


def multi_device_visitors(history: DataFrame, key: str = "visitor_id",
                          device: str = "device_fingerprint") -> DataFrame:
    """Every device of the visitors seen on several, one row per visitor and device."""
    counts = history.groupBy(key).agg(F.max("device_no").alias("device_count")).filter("device_count > 1")
    return history.join(counts, key).select(key, "device_count", "device_no", F.col(device).alias("device"))


def rage_clicks(events: DataFrame, key: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The fifth click inside two seconds; counting then starts anew.

    A click can be a hit when its fourth predecessor is under two seconds old.
    Of these candidates a hit blocks the next four clicks of the session. That
    rule has five states (clicks still blocked), so a session is cut into chunks
    of clicks: each chunk says how it maps the state it is entered with, and
    the maps are chained chunk by chunk. No session is ever gathered whole.
    """
    clicks = (events.filter((F.col("type") == "click") & F.col(key).isNotNull())
              .select(key, *ORDER, F.unix_millis("ts").alias("_ms")))
    hot = heavy_keys(clicks, [key], hot_rows)
    seen = along(clicks, [key], ORDER, {
        "_no": RunningSum(F.lit(1)), "_last": Trailing(F.col("_ms"), RAGE_CLICKS - 1)}, hot)
    near = (F.size("_last") == RAGE_CLICKS - 1) & (
        F.col("_ms") - F.get("_last", 0) < RAGE_MILLIS)
    chunks = (seen.filter(near)
              .withColumn("_chunk", F.floor(F.col("_no") / CHUNK).cast("long"))
              .groupBy(key, "_chunk")
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.col("_no").cast("long").alias("no"), *ORDER))).alias("_c")))
    # State: number of clicks at the start of the chunk that are still blocked.
    chunks = chunks.withColumn("_exits", F.expr(f"""
        transform(sequence(0, {RAGE_CLICKS - 1}), s -> cast(greatest(0, aggregate(_c,
            _chunk * {CHUNK} + s,
            (free, c) -> if(c.no >= free, c.no + {RAGE_CLICKS}, free))
            - (_chunk + 1) * {CHUNK}) as int))"""))
    entered = chunks.join(_entry_states(chunks.select(key, "_chunk", "_exits"), key),
                          [key, "_chunk"])
    hits = entered.withColumn("_hits", F.expr(f"""
        aggregate(_c, named_struct('free', _chunk * {CHUNK} + _entry, 'hits', slice(_c, 1, 0)),
            (a, c) -> if(c.no >= a.free,
                named_struct('free', c.no + {RAGE_CLICKS}, 'hits', array_append(a.hits, c)),
                a)).hits"""))
    return hits.select(key, F.explode("_hits").alias("_h")).select(key, "_h.event_id", "_h.ts")


def _entry_states(chunks: DataFrame, key: str) -> DataFrame:
    """State each chunk is entered with: ``key, _chunk, _entry``.

    Chained in two levels of at most 1,000 chunks, so no list gets long. A
    chunk whose predecessor is missing had no candidate before it and is
    entered free.
    """
    blocks = (chunks.withColumn("_block", F.floor(F.col("_chunk") / CHUNKS_PER_BLOCK).cast("long"))
              .groupBy(key, "_block")
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.col("_chunk").alias("at"), F.col("_exits").alias("exits")))).alias("_m")))

    def chained(first: str) -> str:
        return f"""aggregate(_m, named_struct('at', {first} - 1, 'state', cast(s as int)),
            (a, m) -> named_struct('at', m.at, 'state',
                get(m.exits, if(m.at = a.at + 1, a.state, 0))))"""

    last = f"(_block + 1) * {CHUNKS_PER_BLOCK} - 1"
    blocks = blocks.withColumn("_exits", F.expr(f"""
        transform(sequence(0, {RAGE_CLICKS - 1}), s -> transform(array(
            {chained(f'_block * {CHUNKS_PER_BLOCK}')}),
            e -> if(e.at = {last}, e.state, 0))[0])"""))

    def entries(table: str, start: str, first: str) -> str:
        return f"""aggregate({table}, named_struct('at', {first} - 1, 'state', cast({start} as int),
                'out', cast(array() as array<struct<at: bigint, entry: int>>)),
            (a, m) -> named_struct('at', m.at, 'state',
                get(m.exits, if(m.at = a.at + 1, a.state, 0)),
                'out', array_append(a.out, named_struct('at', m.at,
                    'entry', if(m.at = a.at + 1, a.state, 0))))).out"""

    tops = (blocks.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("_block").alias("at"), F.col("_exits").alias("exits")))).alias("_t"))
            .select(key, F.explode(F.expr(entries("_t", "0", "_t[0].at"))).alias("_e"))
            .select(key, F.col("_e.at").alias("_block"), F.col("_e.entry").alias("_start")))
    return (blocks.join(tops, [key, "_block"])
            .select(key, F.explode(F.expr(
                entries("_m", "_start", f"_block * {CHUNKS_PER_BLOCK}"))).alias("_e"))
            .select(key, F.col("_e.at").alias("_chunk"), F.col("_e.entry").alias("_entry")))


def scroll_milestones(events: DataFrame, key: str = "session_id", exact: bool = False,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Scroll marks a page load reaches, each once.

    A jump from 20 to 60 percent passes 25 and 50. With ``exact`` a mark counts
    only when a new maximum equals it, as the browser script does.
    """
    depth = F.round(payload_number(F.col("data"), "depth")).cast("int")
    samples = (events.filter((F.col("type") == "scroll_depth") & F.col(key).isNotNull())
               .select(key, *ORDER, depth.alias("depth")).filter("depth is not null"))
    hot = heavy_keys(samples, [key], hot_rows)
    out = along(samples, [key], ORDER,
                {"_max": RunningMax(F.col("depth"), before=True)}, hot)
    before = F.coalesce("_max", F.lit(0))
    marks = F.array(*[F.lit(m) for m in SCROLL_MARKS])
    if exact:
        passed = F.filter(marks, lambda m: (m == F.col("depth")) & (F.col("depth") > before))
    else:
        passed = F.filter(marks, lambda m: (m > before) & (m <= F.col("depth")))
    return out.select(key, *ORDER, F.explode(passed).alias("milestone"))


def video_milestones(events: DataFrame, key: str = "session_id") -> DataFrame:
    """First time each video mark is reached in a page load.

    ``watched`` needs ten seconds or a quarter of the video; progress marks are
    25, 50 and 75 percent; ``complete`` is the end. Plain minima per video.
    """
    data = F.col("data")
    samples = (events.filter(F.col("type").startswith("video_") & F.col(key).isNotNull())
               .select(key, "ts", "event_id", "type",
                       F.coalesce(payload(data, "videoId"), payload(data, "src")).alias("video_id"),
                       payload_number(data, "currentTime").alias("at"),
                       payload_number(data, "duration").alias("length"))
               .filter("video_id is not null")
               .withColumn("pct", F.when(F.col("length") > 0, F.col("at") / F.col("length") * 100)))
    place = F.struct(*ORDER)
    playing = F.col("pct").isNotNull()
    watched = playing & ((F.col("at") >= 10) | (F.col("pct") >= 25))
    done = F.coalesce(F.col("pct") >= 100, F.lit(False)) | (F.col("type") == "video_complete")
    label = F.when(F.col("at") >= 10, "time").otherwise("percentage")
    firsts = samples.groupBy(key, "video_id").agg(
        F.min(F.when(watched, F.struct(*ORDER, label.alias("threshold")))).alias("watched"),
        *[F.min(F.when(F.col("pct") >= m, place)).alias(f"progress_{m}") for m in VIDEO_MARKS],
        F.min(F.when(done, place)).alias("complete"))
    none = F.lit(None).cast("string")
    rows = [F.when(F.col("watched").isNotNull(), F.struct(
        F.lit("watched").alias("milestone"), F.col("watched.ts").alias("ts"),
        F.col("watched.threshold").alias("threshold")))]
    for name in [f"progress_{m}" for m in VIDEO_MARKS] + ["complete"]:
        rows.append(F.when(F.col(name).isNotNull(), F.struct(
            F.lit(name).alias("milestone"), F.col(f"{name}.ts").alias("ts"),
            none.alias("threshold"))))
    return (firsts.select(key, "video_id", F.explode(F.array_compact(F.array(*rows))).alias("m"))
            .select(key, "video_id", "m.*"))


def page_engagement(events: DataFrame, key: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per page exit: pages so far (at most 20 count), seconds per page, reading."""
    rows = events.filter(F.col(key).isNotNull() & F.col("type").isin("page_view", "page_exit"))
    hot = heavy_keys(rows, [key], hot_rows)
    out = along(rows, [key], ORDER, {
        "_pages": RunningSum(F.when(F.col("type") == "page_view", 1).otherwise(0)),
        # The earliest time so far, as the greatest of the negated times.
        "_start": RunningMax(-F.unix_micros("ts"))}, hot).filter("type = 'page_exit'")
    data = F.col("data")
    pages = F.least("_pages", F.lit(HISTORY_PAGES))
    total = F.round((F.unix_micros("ts") + F.col("_start")) / F.lit(1_000_000))
    reading, scanning, on_page = [F.coalesce(payload_number(data, n), F.lit(0.0))
                                  for n in ("readingTime", "scanningTime", "totalTime")]
    return out.select(
        key, *ORDER, pages.cast("long").alias("pages_this_session"),
        F.when(pages > 0, F.round(total / pages)).otherwise(total).cast("long").alias("time_per_page"),
        F.when(on_page > 0, F.round(reading / on_page, 4)).otherwise(0.0).alias("reading_ratio"),
        F.when(reading > scanning, "high").otherwise("low").alias("engagement_quality"))


def reading_time(samples: DataFrame, key: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds spent reading and scanning, from scroll samples ``scroll``.

    Hardly moved for a second, or moved a little: reading. Moved over 300
    pixels: scanning. Exactly 300 counts as neither.
    """
    samples = samples.filter(F.col(key).isNotNull() & F.col("scroll").isNotNull())
    hot = heavy_keys(samples, [key], hot_rows)
    out = along(samples, [key], ORDER, {
        "_scroll": Previous(F.col("scroll")), "_ts": Previous(F.col("ts"))}, hot)
    moved = F.abs(F.col("scroll") - F.coalesce("_scroll", F.lit(0)))
    # The first sample is taken one second after the page started at the top.
    waited = F.coalesce(F.unix_micros("ts") - F.unix_micros("_ts"), F.lit(1_000_000)) >= 1_000_000
    still = (moved < READING_PIXELS) & waited
    slow = (moved > 0) & (moved < SCANNING_PIXELS)
    return out.groupBy(key).agg(
        F.count_if(still | slow).alias("reading_time"),
        F.count_if(~still & (moved > SCANNING_PIXELS)).alias("scanning_time"))


def active_time(events: DataFrame, key: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds a session's page was visible: not between focus lost and gained."""
    rows = events.filter(F.col(key).isNotNull())
    hot = heavy_keys(rows, [key], hot_rows)
    focus = F.when(F.col("type").isin("focus_lost", "focus_gained"), F.struct(*ORDER, "type"))
    out = along(rows.select(key, *ORDER, "type"), [key], ORDER, {
        "_next": Following(F.col("ts")), "_focus": RunningMax(focus)}, hot)
    hidden: Column = F.coalesce(F.col("_focus.type") == "focus_lost", F.lit(False))
    gap = F.coalesce(F.unix_micros("_next") - F.unix_micros("ts"), F.lit(0))
    return out.groupBy(key).agg(
        F.floor(F.sum(F.when(hidden, 0).otherwise(gap)) / F.lit(1_000_000))
        .cast("long").alias("active_seconds"))
