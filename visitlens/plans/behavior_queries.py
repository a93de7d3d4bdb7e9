"""Named queries: sessions and behaviour along them."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlens.functions.scalars import payload_number
from visitlens.operators import behavior, reports, sessions
from visitlens.plans.catalog import events, query, raw_events

ORDER = "order by ts, event_id"


def sessions_sql(gap: str) -> str:
    return f"""
    select *, cast(sum(case when before is not null and ts - before <= interval {gap} then 0 else 1 end)
            over (partition by visitor_id {ORDER} rows unbounded preceding) as bigint) as session_number
    from (select *, lag(ts) over (partition by visitor_id {ORDER}) as before
        from te where visitor_id is not null)"""


@query("sessionize", f"select event_id, visitor_id, session_number from ({sessions_sql('30 minute')})")
def sessionize(spark, folder):
    return sessions.sessionize(events(spark, folder)).select("event_id", "visitor_id", "session_number")


@query("sessionize_6h", f"select event_id, visitor_id, session_number from ({sessions_sql('6 hour')})")
def sessionize_6h(spark, folder):
    return sessions.sessionize(events(spark, folder), 6 * 3600).select(
        "event_id", "visitor_id", "session_number")


MARKS = " + ".join(f"case when max(depth) >= {m} then 1 else 0 end" for m in (25, 50, 75, 90, 100))
ROLLUP_SQL = f"""
    select visitor_id, session_number, min(ts) as start_time, max(ts) as end_time,
        arg_min(url, (ts, event_id)) as first_page, arg_max(url, (ts, event_id)) as last_page,
        count(*) filter (type = 'page_view') as pageviews, count(*) filter (type = 'click') as clicks,
        cast(max(depth) as integer) as max_scroll_depth,
        count(*) filter (type = 'form_start') as forms_started,
        count(*) filter (type = 'form_submit') as forms_submitted,
        count(distinct video) filter (type = 'video_watched') as videos_watched,
        cast(coalesce(sum(active_s) filter (type = 'page_exit'), 0) as bigint) as active_time,
        arg_min(country, (ts, event_id)) filter (country is not null) as country,
        count(*) as events,
        cast(floor(epoch(max(ts) - min(ts))) as bigint) as duration,
        arg_min(city, (ts, event_id)) filter (city <> '') as city,
        arg_min(region, (ts, event_id)) filter (region is not null) as region,
        case min(user_id) % 4 when 0 then 'Chrome' when 1 then 'Safari' when 2 then 'Firefox' end as browser,
        case min(user_id) % 4 when 0 then 'Windows' when 1 then 'macOS' when 2 then 'Linux' end as operating_system,
        case when min(user_id) % 8 = 0 then 'mobile' when min(user_id) % 4 <> 3 then 'desktop' end as device,
        round(4 * least(25.0, count(*) filter (type = 'page_view') * 1.5::double
            + coalesce(sum(active_s) filter (type = 'page_exit'), 0) / 60.0::double + {MARKS})::double, 2)
            as engagement_score
    from ({sessions_sql('6 hour')}) group by visitor_id, session_number"""


def rolled_up(spark, folder):
    cut = sessions.sessionize(events(spark, folder), 6 * 3600)
    return sessions.session_rollup(cut, ["visitor_id", "session_number"])


@query("session_rollup", ROLLUP_SQL)
def session_rollup(spark, folder):
    return rolled_up(spark, folder)


@query("visitor_key", """
    select event_id, coalesce(visitor_id, b, device_fingerprint) as visitor_key
    from te left join (select session_id, arg_min(browser_id, (ts, event_id)) as b from te
        where browser_id is not null group by session_id) using (session_id)""")
def visitor_key(spark, folder):
    return sessions.visitor_key(raw_events(spark, folder)).select("event_id", "visitor_key")


@query("visit_number", f"""
    select event_id, row_number() over (partition by browser_id {ORDER}) as visit_number,
        row_number() over (partition by browser_id {ORDER}) = 1 as is_first_visit,
        row_number() over (partition by browser_id {ORDER}) > 1 as is_return_visitor
    from te where type = 'page_view' and browser_id is not null""")
def visit_number(spark, folder):
    return behavior.visit_number(events(spark, folder)).select(
        "event_id", "visit_number", "is_first_visit", "is_return_visitor")


# Whole visitor histories, so that there are pages to come back to.
PATHS_SQL = f"""
    select event_id, visitor_id, lag(path) over (partition by visitor_id {ORDER}) as previous_page,
        coalesce(list_contains(list(path) over (partition by visitor_id {ORDER}
            rows between 20 preceding and 1 preceding), path)
            and lag(path) over (partition by visitor_id {ORDER}) <> path, false) as is_backtracking
    from te where type = 'page_view' and visitor_id is not null"""


def paths(spark, folder):
    return behavior.page_path(events(spark, folder), "visitor_id")


@query("previous_page", f"""
    select event_id, lag(path) over (partition by session_id {ORDER}) as previous_page
    from te where type = 'page_view'""")
def previous_page(spark, folder):
    return behavior.page_path(events(spark, folder)).select("event_id", "previous_page")


@query("backtracking", f"select event_id, is_backtracking from ({PATHS_SQL})")
def backtracking(spark, folder):
    return paths(spark, folder).select("event_id", "is_backtracking")


@query("backtracking_visitors", f"""
    select visitor_id, count(*) as pageviews, count(*) filter (is_backtracking) as backtracks,
        round(count(*) filter (is_backtracking)::double / count(*), 4) as backtrack_share
    from ({PATHS_SQL}) group by visitor_id having count(*) filter (is_backtracking) > 0""")
def backtracking_visitors(spark, folder):
    return behavior.backtracking_visitors(paths(spark, folder))


@query("device_switches", f"""
    select visitor_id, event_id, ts, row_number() over w as device_no, row_number() over w - 1 as previous_device_count,
        device_fingerprint as new_device
    from (select visitor_id, device_fingerprint, ts, event_id from te where visitor_id is not null
        qualify row_number() over (partition by visitor_id, device_fingerprint {ORDER}) = 1)
    window w as (partition by visitor_id {ORDER})
    qualify row_number() over w > 1""")
def device_switches(spark, folder):
    return behavior.device_switches(events(spark, folder))


# Sample clicks are minutes apart; a click's time is compressed to make bursts.
COMPRESS = 500_000


@query("rage_clicks", f"""
    with recursive c as (
        select user_id, event_id, make_timestamp(cast(floor(epoch_us(ts) / {COMPRESS}) as bigint)) as ts,
            row_number() over (partition by user_id {ORDER}) as n
        from te where type = 'click'),
    cand as (
        select *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts, 4) over (partition by user_id order by n)) < 2000, false) as near
        from c),
    walk as (
        select user_id, event_id, ts, n, near as hit, case when near then 4 else 0 end as blocked
        from cand where n = 1
        union all
        select x.user_id, x.event_id, x.ts, x.n, x.near and w.blocked = 0,
            case when w.blocked > 0 then w.blocked - 1 when x.near then 4 else 0 end
        from walk w join cand x on x.user_id = w.user_id and x.n = w.n + 1)
    select 'u' || cast(user_id as varchar) as person, event_id, ts from walk where hit""")
def rage_clicks(spark, folder):
    ev = events(spark, folder).withColumns({
        "ts": F.timestamp_micros(F.floor(F.unix_micros("ts") / COMPRESS)),
        "person": F.concat(F.lit("u"), F.regexp_extract("session_id", "s([0-9]+)-", 1))})
    return behavior.rage_clicks(ev, "person")


def scroll_sql(test: str) -> str:
    return f"""
    select session_id, ts, event_id, milestone from (
        select session_id, ts, event_id, depth, coalesce(max(depth) over (partition by session_id {ORDER}
            rows between unbounded preceding and 1 preceding), 0) as before
        from te where type = 'scroll_depth')
    join (select unnest([25, 50, 75, 90, 100]) as milestone) on {test}"""


@query("scroll_milestones", scroll_sql("milestone > before and milestone <= depth"))
def scroll_milestones(spark, folder):
    return behavior.scroll_milestones(events(spark, folder))


@query("scroll_milestones_exact", scroll_sql("milestone > before and milestone = depth"))
def scroll_milestones_exact(spark, folder):
    return behavior.scroll_milestones(events(spark, folder), exact=True)


@query("video_milestones", """
    with v as (select session_id, video as video_id, ts, event_id, type, position_s as secs,
            position_s * 100.0 / duration_s as pct
        from te where type in ('video_watched', 'video_complete'))
    select session_id, video_id, 'watched' as milestone, min(ts) as ts,
        arg_min(case when secs >= 10 then 'time' else 'percentage' end, (ts, event_id)) as threshold
    from v where secs >= 10 or pct >= 25 group by 1, 2
    union all select session_id, video_id, 'progress_25', min(ts), null from v where pct >= 25 group by 1, 2
    union all select session_id, video_id, 'progress_50', min(ts), null from v where pct >= 50 group by 1, 2
    union all select session_id, video_id, 'progress_75', min(ts), null from v where pct >= 75 group by 1, 2
    union all select session_id, video_id, 'complete', min(ts), null from v
        where pct >= 100 or type = 'video_complete' group by 1, 2""")
def video_milestones(spark, folder):
    return behavior.video_milestones(events(spark, folder))


@query("page_engagement", f"""
    select session_id, ts, event_id, cast(least(pages, 20) as bigint) as pages_this_session,
        cast(case when pages > 0 then round(round(secs) / least(pages, 20)) else round(secs) end as bigint)
            as time_per_page,
        round(cast(reading_s as double) / (active_s + 30), 4) as reading_ratio,
        case when reading_s > scanning_s then 'high' else 'low' end as engagement_quality
    from (select *, count(*) filter (type = 'page_view') over w as pages,
            (epoch_us(ts) - epoch_us(min(ts) over w)) / 1000000.0 as secs
        from te where type in ('page_view', 'page_exit')
        window w as (partition by session_id {ORDER} rows unbounded preceding))
    where type = 'page_exit'""")
def page_engagement(spark, folder):
    return behavior.page_engagement(events(spark, folder))


@query("reading_time", f"""
    select visitor_id, count(*) filter (still or (moved > 0 and moved < 300)) as reading_time,
        count(*) filter (not still and moved > 300) as scanning_time
    from (select *, moved < 50 and (p_ts is null or ts - p_ts >= interval 1 second) as still
        from (select visitor_id, ts, abs(scroll_px - coalesce(lag(scroll_px) over w, 0)) as moved,
                lag(ts) over w as p_ts
            from te where type = 'scroll_depth' and visitor_id is not null
            window w as (partition by visitor_id {ORDER})))
    group by visitor_id""")
def reading_time(spark, folder):
    samples_ = events(spark, folder).filter("type = 'scroll_depth'").withColumn(
        "scroll", payload_number(F.col("data"), "scrollTop"))
    return behavior.reading_time(samples_, "visitor_id")


@query("active_time", f"""
    select session_id, cast(floor(sum(case when state = 'focus_lost' then 0 else gap end) / 1000000) as bigint)
        as active_seconds
    from (select session_id, coalesce(epoch_us(lead(ts) over w) - epoch_us(ts), 0) as gap,
            last_value(case when type in ('focus_lost', 'focus_gained') then type end ignore nulls)
                over (w rows unbounded preceding) as state
        from te window w as (partition by session_id {ORDER}))
    group by session_id""")
def active_time(spark, folder):
    return behavior.active_time(events(spark, folder))


# Batches of every fourth user arrive twice.
@query("dedupe_events", """
    select event_id, visitor_id, session_id, raw_type, ts, case when user_id % 4 = 1 then 2 else 1 end::bigint as copies
    from te""")
def dedupe_events(spark, folder):
    ev = raw_events(spark, folder)
    user = F.regexp_extract("session_id", "s([0-9]+)-", 1).cast("long")
    again = ev.filter(user % 4 == 1).withColumn("event_id", F.col("event_id") + 10**15)
    return sessions.dedupe_events(ev.unionByName(again)).select(
        "event_id", "visitor_id", "session_id", "raw_type", "ts", "copies")


@query("recent_rolled_up_sessions", f"""
    select visitor_id, session_number, start_time, pageviews from ({ROLLUP_SQL})
    order by start_time desc, visitor_id, session_number limit 50""")
def recent_rolled_up_sessions(spark, folder):
    return reports.recent_sessions(rolled_up(spark, folder), 50, "visitor_id", "session_number").select(
        "visitor_id", "session_number", "start_time", "pageviews")


