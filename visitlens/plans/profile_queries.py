"""Named queries: profiles, scores, reports and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlens.functions import scores
from visitlens.functions.emails import contact_email
from visitlens.operators import behavior, campaigns, enrich, identity, profiles, reports, sessions
from visitlens.operators.periods import before, in_period
from visitlens.plans.catalog import events, query, sql_hash32
from visitlens.plans.flows import build_profiles
from visitlens.sources import samples

AS_OF = samples.AS_OF


def behavior_sql(days: int) -> str:
    return f"""
    select visitor_id, count(distinct session_id) as total_sessions,
        count(distinct case when type = 'page_view' then ts end) as total_pageviews,
        max(ts) as last_visit, min(ts) as first_visit,
        bool_or(url like '%/pricing%') as viewed_pricing, bool_or(url like '%/demo%') as requested_demo,
        bool_or(type = 'form_submit') as submitted_form
    from te where visitor_id is not null and ts <= timestamp '{AS_OF}'
        and ts >= timestamp '{AS_OF}' - interval {days} day
    group by visitor_id"""


SUMMARY_SQL = """
    select tracking_id, count(*) as total_campaigns,
        '[' || string_agg(case when r <= 5 then '{"campaign_id":"' || campaign_id || '","campaign_name":"' ||
            campaign_name || '","status":"' || status || '"}' end, ',' order by r) || ']' as campaigns
    from (select *, row_number() over (partition by tracking_id order by added_at desc, member_id desc) as r
        from members) group by tracking_id"""

CONTACT = "coalesce(nullif(work_email, ''), personal_email)"
RULE_SQL = """case when coalesce(total_sessions, 0) >= 3 and coalesce(viewed_pricing, false) then 'hot'
    when coalesce(total_sessions, 0) >= 2 or coalesce(viewed_pricing, false) then 'warm'
    when b.visitor_id is not null then 'cold' else 'new' end"""


SERVED_SQL = """phone, linkedin_url, company_website, company_description, company_headcount,
        nullif(company_linkedin, '') as company_linkedin, nullif(job_title, '') as job_title,
        nullif(job_seniority, '') as job_seniority, job_department"""


def profiles_sql(days: int) -> str:
    return f"""
    select l.tracking_id, l.lead_id,
        coalesce(nullif(first_name, ''), split_part(person_name, ' ', 1)) as first_name,
        coalesce(last_name, substr(person_name, strpos(person_name, ' ') + 1)) as last_name,
        person_name, {CONTACT} as email,
        coalesce(company_website, split_part({CONTACT}, '@', 2)) as domain,
        company_name, company_industry, company_revenue, {SERVED_SQL},
        coalesce(total_sessions, 0) as total_sessions, coalesce(total_pageviews, 0) as total_pageviews,
        last_visit, first_visit, coalesce(viewed_pricing, false) as viewed_pricing,
        coalesce(requested_demo, false) as requested_demo,
        coalesce(submitted_form, false) as submitted_form, b.visitor_id is not null as has_visited,
        b.visitor_id is null as is_first_visit, coalesce(total_campaigns, 0) as total_campaigns,
        coalesce(total_campaigns, 0) > 0 as is_in_campaign, campaigns, {RULE_SQL} as engagement_level
    from leads l left join ({behavior_sql(days)}) b on b.visitor_id = l.tracking_id
    left join ({SUMMARY_SQL}) c on c.tracking_id = l.tracking_id
    where l.tracking_id <> ''"""


PROFILES_SQL = profiles_sql(90)


def profile_table(spark, folder, days: int = 90):
    return build_profiles(events(spark, folder), samples.leads(spark, folder),
                          samples.campaign_members(spark, folder), AS_OF, days)


@query("visitor_behavior_90d", behavior_sql(90))
def visitor_behavior_90d(spark, folder):
    return profiles.visitor_behavior(events(spark, folder), AS_OF)


@query("campaign_summary", SUMMARY_SQL)
def campaign_summary(spark, folder):
    out = profiles.campaign_summary(samples.campaign_members(spark, folder))
    return out.withColumn("campaigns", F.to_json("campaigns"))


@query("lead_profile_build", PROFILES_SQL)
def lead_profile_build(spark, folder):
    return profile_table(spark, folder)


@query("engagement_rule", f"select tracking_id, engagement_level from ({PROFILES_SQL})")
def engagement_rule(spark, folder):
    return profile_table(spark, folder).select("tracking_id", "engagement_level")


def activity_sql(until: str = AS_OF) -> str:
    return f"""
    select visitor_id, count(*) as total_sessions, cast(sum(pageviews) as bigint) as total_pageviews,
        cast(sum(active) as bigint) as total_active_time,
        cast(sum(marks) as bigint) as scroll_milestones, max(last) as last_visit_at,
        cast(sum(pricing) as bigint) as pricing_page_visits, cast(sum(cases) as bigint) as case_study_views,
        cast(sum(products) as bigint) as product_page_views, cast(sum(forms) as bigint) as form_submissions,
        cast(sum(videos) as bigint) as video_completions
    from (select visitor_id, session_id, count(*) filter (type = 'page_view') as pageviews,
            coalesce(sum(active_s) filter (type = 'page_exit'), 0) as active, max(ts) as last,
            (select count(*) from unnest([25, 50, 75, 90, 100]) as m(v)
                where v <= max(depth) filter (type = 'scroll_depth')) as marks,
            count(*) filter (type = 'page_view' and url like '%/pricing%') as pricing,
            count(*) filter (type = 'page_view' and url like '%/case-stud%') as cases,
            count(*) filter (type = 'page_view' and url like '%/product%') as products,
            count(*) filter (type = 'form_submit') as forms,
            count(*) filter (type = 'video_complete') as videos
        from te where visitor_id is not null and ts <= timestamp '{until}'
        group by visitor_id, session_id) group by visitor_id""".replace(
        """(select count(*) from unnest([25, 50, 75, 90, 100]) as m(v)
                where v <= max(depth) filter (type = 'scroll_depth'))""",
        " + ".join(f"case when max(depth) filter (type = 'scroll_depth') >= {m} then 1 else 0 end"
                   for m in (25, 50, 75, 90, 100)))


def scored_sql(until: str = AS_OF, as_of: str = AS_OF) -> str:
    """Lead profiles with score and level."""
    counters = ["total_sessions", "total_pageviews", "total_active_time", "scroll_milestones",
                "pricing_page_visits", "case_study_views", "product_page_views",
                "form_submissions", "video_completions"]
    return f"""
    select *, case when intent_score >= 80 then 'burning' when intent_score >= 60 then 'hot'
        when intent_score >= 40 then 'warm' else 'cold' end as engagement_level
    from (select *, round(least(100.0, case when last_visit_at is null then 0
            when age <= 24 then 30 when age <= 72 then 25 when age <= 168 then 20
            when age <= 336 then 15 when age <= 720 then 10 else 5 end
        + least(total_sessions * 4, 20)
        + least(25.0, total_pageviews * 1.5::double + total_active_time / 60.0::double + scroll_milestones)
        + least(pricing_page_visits * 8 + case_study_views * 5 + product_page_views * 4, 25)
        + least(form_submissions * 15 + video_completions * 5, 20))::double, 2) as intent_score
    from (select lead_id, tracking_id, {CONTACT} as email, company_name, last_visit_at,
        epoch(timestamp '{as_of}' - last_visit_at) / 3600.0 as age,
        {', '.join(f'coalesce({c}, 0) as {c}' for c in counters)}
        from leads left join ({activity_sql(until)}) a on a.visitor_id = tracking_id
        where tracking_id <> ''))"""


def scored_profiles(spark, folder, until: str = AS_OF, as_of: str = AS_OF):
    seen = in_period(events(spark, folder), until=until)
    return profiles.lead_profiles(samples.leads(spark, folder), profiles.lead_activity(seen), as_of)


@query("lead_profiles", f"select * exclude (age) from ({scored_sql()})")
def lead_profiles(spark, folder):
    return scored_profiles(spark, folder)


@query("intent_score", f"select lead_id, intent_score from ({scored_sql()})")
def intent_score(spark, folder):
    return scored_profiles(spark, folder).select("lead_id", "intent_score")


@query("engagement_level", f"select lead_id, engagement_level from ({scored_sql()})")
def engagement_level(spark, folder):
    return scored_profiles(spark, folder).select("lead_id", "engagement_level")


@query("visitor_totals", """
    select visitor_id, count(*) filter (type = 'page_view') as total_pageviews,
        count(*) filter (type = 'click') as total_clicks, count(distinct session_id) as total_sessions,
        max(ts) as last_seen_at
    from te where visitor_id is not null group by visitor_id""")
def visitor_totals(spark, folder):
    return sessions.visitor_totals(events(spark, folder))


@query("first_touch", """
    select visitor_id, ts as first_seen_at, url as first_page, referrer as first_referrer, country,
        nullif(city, '') as city, region, timezone,
        case when k % 3 = 1 then 'last' end as utm_source,
        case when k % 3 = 2 then 'c' || cast(k % 5 as varchar) end as utm_campaign
    from te where visitor_id is not null
    qualify row_number() over (partition by visitor_id order by ts, event_id) = 1""")
def first_touch(spark, folder):
    return sessions.first_touch(events(spark, folder)).select(
        "visitor_id", "first_seen_at", "first_page", "first_referrer", "country", "city", "region", "timezone",
        "utm_source", "utm_campaign")


@query("company_activity", f"""
    select {sql_hash32('part')} as company_identifier, visitors, sessions, events, first_seen_at,
        last_seen_at, visitors > 1 as has_multiple_visitors
    from (select split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) as part,
            count(distinct visitor_id) as visitors, count(distinct session_id) as sessions,
            count(*) as events, min(ts) as first_seen_at, max(ts) as last_seen_at
        from te group by 1)""")
def company_activity(spark, folder):
    return reports.company_activity(enrich.company_identifier(events(spark, folder)))


@query("visitor_return_patterns", """
    select visitor_id, count(distinct cast(ts as date)) as total_visit_days, min(ts) as first_visit,
        max(ts) as last_visit, cast(cast(max(ts) as date) - cast(min(ts) as date) as integer) as span_days,
        round(cast(cast(max(ts) as date) - cast(min(ts) as date) as double)
            / nullif(count(distinct cast(ts as date)) - 1, 0), 4) as mean_gap_days
    from te where visitor_id is not null group by visitor_id""")
def visitor_return_patterns(spark, folder):
    return reports.visitor_return_patterns(events(spark, folder))


@query("content_depth", """
    select session_id, count(*) filter (type = 'page_view') as pageviews,
        count(*) filter (type = 'page_exit') as exits,
        round(avg(active_s + 30) filter (type = 'page_exit'), 3) as mean_seconds_per_page,
        round(cast(sum(reading_s) filter (type = 'page_exit') as double)
            / sum(active_s + 30) filter (type = 'page_exit'), 4) as reading_ratio,
        round(cast(count(*) filter (type = 'page_exit' and reading_s > scanning_s) as double)
            / nullif(count(*) filter (type = 'page_exit'), 0), 4) as high_quality_share
    from te where type in ('page_view', 'page_exit') group by session_id""")
def content_depth(spark, folder):
    return reports.content_depth(events(spark, folder))


@query("high_intent_leads",
       f"select lead_id, email, intent_score, engagement_level from ({scored_sql()}) where intent_score >= 60")
def high_intent_leads(spark, folder):
    return reports.high_intent_leads(scored_profiles(spark, folder)).select(
        "lead_id", "email", "intent_score", "engagement_level")


CLICKS_SQL = """
    select coalesce(tracking_id, visitor_id) as tracking_id, count(*) as clicks,
        min(ts) as first_click_at, max(ts) as last_clicked_at
    from te where type = 'email_click' and coalesce(tracking_id, visitor_id) is not null group by 1"""


@query("campaign_performance", f"""
    select campaign_id, campaign_name, count(*) as total_recipients,
        cast(coalesce(sum(clicks), 0) as bigint) as clicks, count(h.tracking_id) as high_intent_leads,
        round(count(h.tracking_id)::double / count(*) * 100, 2) as conversion_rate
    from (select distinct campaign_id, campaign_name, tracking_id from members) m
    left join ({CLICKS_SQL}) c on c.tracking_id = m.tracking_id
    left join (select distinct tracking_id from ({scored_sql()}) where intent_score >= 60) h
        on h.tracking_id = m.tracking_id
    group by campaign_id, campaign_name""")
def campaign_performance(spark, folder):
    clicks = campaigns.email_clicks(events(spark, folder)).select("tracking_id", "clicks")
    return reports.campaign_performance(samples.campaign_members(spark, folder), clicks,
                                        scored_profiles(spark, folder))


@query("intent_distribution", f"""
    select engagement_level, cast(least(floor(intent_score / 10) * 10, 90) as integer) as score_from,
        count(*) as leads from ({scored_sql()}) group by 1, 2""")
def intent_distribution(spark, folder):
    return reports.intent_distribution(scored_profiles(spark, folder))


@query("active_lead_ids", f"""
    select distinct 'L' || cast(user_id as varchar) as lead_id from te
    where visitor_id is not null and ts >= timestamp '{AS_OF}' - interval 48 hour""")
def active_lead_ids(spark, folder):
    owned = events(spark, folder).withColumn("lead_id", F.concat(
        F.lit("L"), F.substring("visitor_id", 2, 20)))
    return identity.active_lead_ids(owned, before(AS_OF, hours=48))


@query("recent_events", f"""
    select event_id, ts, type, visitor_id, url, country from te
    where ts >= timestamp '{AS_OF}' - interval 24 hour""")
def recent_events(spark, folder):
    return reports.recent_events(events(spark, folder), AS_OF)


@query("recent_sessions", """
    select session_id, min(ts) as start_time, max(ts) as end_time, count(*) as events
    from te group by session_id order by start_time desc, session_id limit 100""")
def recent_sessions(spark, folder):
    per = events(spark, folder).groupBy("session_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("events"))
    return reports.recent_sessions(per, 100, "session_id")


@query("top_hot_leads", f"""
    select lead_id, email, company_name, intent_score, last_visit_at, pricing_page_visits
    from ({scored_sql()}) where intent_score >= 60 order by intent_score desc, lead_id limit 10""")
def top_hot_leads(spark, folder):
    return reports.top_hot_leads(scored_profiles(spark, folder))


@query("unverified_emails", f"""
    select lead_id, {CONTACT} as email, tracking_id from leads where email_status = 'unverified'
    order by lead_id limit 1000""")
def unverified_emails(spark, folder):
    return reports.unverified_emails(samples.leads(spark, folder),
                                     contact_email(F.col("work_email"), F.col("personal_email")))


@query("leads_page", """
    select lead_id, tracking_id, updated_at from leads order by updated_at desc, lead_id
    limit 50 offset 100""")
def leads_page(spark, folder):
    return reports.leads_page(samples.leads(spark, folder).select("lead_id", "tracking_id", "updated_at"),
                              50, 100)


@query("visitor_history", """
    select event_id, ts, type, url from te where visitor_id = 'v8' order by ts desc, event_id desc limit 10""")
def visitor_history(spark, folder):
    return reports.visitor_history(events(spark, folder), "v8").select("event_id", "ts", "type", "url")


@query("leads_added_recently", f"""
    select lead_id, tracking_id, created_at from leads
    where created_at >= timestamp '{AS_OF}' - interval 24 hour and tracking_id is not null
    order by created_at desc, lead_id limit 10""")
def leads_added_recently(spark, folder):
    return reports.leads_added_recently(samples.leads(spark, folder), AS_OF).select(
        "lead_id", "tracking_id", "created_at")


HOT_SQL = f"""
    select lead_id, email, intent_score from ({scored_sql('2024-01-04', '2024-01-04')}) n
    where intent_score >= {scores.HOT_SCORE} and not exists (
        select 1 from ({scored_sql('2024-01-03', '2024-01-03')}) b
        where b.lead_id = n.lead_id and b.intent_score >= {scores.HOT_SCORE})"""


@query("hot_lead_alerts", HOT_SQL)
def hot_lead_alerts(spark, folder):
    now = scored_profiles(spark, folder, "2024-01-04", "2024-01-04")
    earlier = scored_profiles(spark, folder, "2024-01-03", "2024-01-03")
    return profiles.hot_lead_alerts(now, earlier).select("lead_id", "email", "intent_score")


@query("device_history", """
    select visitor_id, device_fingerprint, ts, event_id,
        row_number() over (partition by visitor_id order by ts, event_id) as device_no
    from (select visitor_id, device_fingerprint, ts, event_id from te where visitor_id is not null
        qualify row_number() over (partition by visitor_id, device_fingerprint order by ts, event_id) = 1)""")
def device_history(spark, folder):
    return behavior.device_history(events(spark, folder))


@query("multi_device_visitors", """
    select visitor_id, count(*) over (partition by visitor_id) as device_count,
        row_number() over (partition by visitor_id order by f, e) as device_no, device_fingerprint as device
    from (select visitor_id, device_fingerprint, min(ts) as f, arg_min(event_id, ts) as e from te
        where visitor_id is not null group by 1, 2)
    qualify count(*) over (partition by visitor_id) > 1""")
def multi_device_visitors(spark, folder):
    return behavior.multi_device_visitors(behavior.device_history(events(spark, folder)))
