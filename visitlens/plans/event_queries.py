"""Named queries: event projections, filters and row tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.functions import emails, urls
from visitlens.functions.scalars import filled, payload
from visitlens.operators import audiences, campaigns, enrich
from visitlens.plans.catalog import events, query, raw_events, sql_hash32
from visitlens.plans.profile_queries import PROFILES_SQL, profile_table
from visitlens.session import enable_checkpoints
from visitlens.sources import samples

AS_OF = samples.AS_OF
CAMPAIGN = "camp_001"
QUOTED_TYPES = ", ".join(f"'{t}'" for t in schemas.EVENT_TYPES)
CATEGORY_SQL = """case when type in ('email_sent', 'email_bounced', 'email_replied', 'email_click')
    then 'email' when type in ('email_captured', 'identify', 'browser_emails_scanned')
    then 'system' else 'website' end"""


@query("normalize_event_type", "select event_id, raw_type, type from te")
def normalize_event_type(spark, folder):
    return enrich.typed(raw_events(spark, folder)).select("event_id", "raw_type", "type")


@query("event_category", f"select event_id, type, {CATEGORY_SQL} as category from te")
def event_category(spark, folder):
    return events(spark, folder).select("event_id", "type", "category")


@query("unknown_event_types",
       f"select event_id, type from te where type not in ({QUOTED_TYPES})")
def unknown_event_types(spark, folder):
    return enrich.unknown_event_types(events(spark, folder)).select("event_id", "type")


# Every third event arrives through a tracked link.
@query("identity_from_url", """
    select event_id, case when event_id % 3 = 0 then 'v' || cast(user_id as varchar) end as url_tracking_id,
        case when event_id % 3 = 0 then 'v' || cast(user_id as varchar) else visitor_id end as visitor_id
    from te""")
def identity_from_url(spark, folder):
    ev = raw_events(spark, folder)
    user = F.regexp_extract("session_id", "s([0-9]+)-", 1)
    linked = F.when(F.col("event_id") % 3 == 0, F.concat(
        F.split(F.col("url"), r"\?")[0], F.lit("?x=1&i=v"), user, F.lit("#top"))).otherwise(F.col("url"))
    return (enrich.identity_from_url(ev.withColumn("url", linked))
            .select("event_id", "url_tracking_id", "visitor_id"))


@query("email_submitted_events", """
    select event_id, 'email_submitted' as type, visitor_id is null as previously_anonymous
    from te where type = 'form_submit' and email is not null""")
def email_submitted_events(spark, folder):
    return (enrich.email_submitted_events(events(spark, folder))
            .select("event_id", "type", "previously_anonymous"))


@query("enrich_events", f"""
    select event_id, type, {CATEGORY_SQL} as category, path, true as url_ok,
        {sql_hash32("'10.' || cast(user_id % 25 as varchar)")} as company_identifier,
        case when k % 3 = 1 then '{{"utm_source":"last","utm_medium":""}}'
            when k % 3 = 2 then '{{"utm_campaign":"c' || cast(k % 5 as varchar) || '","q":"a b"}}' end as url_parms,
        case when k % 3 = 1 then 'last' end as utm_source,
        cast(null as varchar) as utm_medium,
        case when k % 3 = 2 then 'c' || cast(k % 5 as varchar) end as utm_campaign,
        cast(null as varchar) as campaign_id,
        left(data, length(data) - 1) || ',"_originalSessionId":"' || session_id || '"}}' as data
    from te""")
def enrich_events(spark, folder):
    out = enrich.enrich_events(raw_events(spark, folder))
    # Key order of a map is not fixed; the text is compared in one order.
    params = F.from_json("url_parms", "map<string,string>")
    ordered = F.when(params["utm_source"].isNotNull(), F.to_json(F.struct(
        params["utm_source"].alias("utm_source"), params["utm_medium"].alias("utm_medium")))).when(
        params.isNotNull(), F.to_json(F.struct(
            params["utm_campaign"].alias("utm_campaign"), params["q"].alias("q"))))
    return out.select("event_id", "type", "category", "path", "url_ok", "company_identifier",
                      ordered.alias("url_parms"), "utm_source", "utm_medium", "utm_campaign",
                      "campaign_id", "data")


@query("url_params", """
    select event_id, 'utm_source' as param, 'last' as value from te where k % 3 = 1
    union all select event_id, 'utm_medium', '' from te where k % 3 = 1
    union all select event_id, 'utm_campaign', 'c' || cast(k % 5 as varchar) from te where k % 3 = 2
    union all select event_id, 'q', 'a b' from te where k % 3 = 2""")
def url_params(spark, folder):
    return enrich.url_params(raw_events(spark, folder))


@query("url_params_of_pages", """
    select page_id, count(*) as params, string_agg(param, ',' order by param) as names from (
        select distinct page_id, split_part(p, '=', 1) as param from (
            select page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as p
            from pages) where p <> '')
    group by page_id""")
def url_params_of_pages(spark, folder):
    params = urls.url_params(F.col("url"))
    return (samples.raw(spark, folder, "pages").select("page_id", params.alias("p"))
            .filter("p is not null")
            .select("page_id", F.size("p").cast("long").alias("params"),
                    F.array_join(F.sort_array(F.map_keys("p")), ",").alias("names")))


@query("utm_fields", """
    select event_id, case when k % 3 = 1 then 'last' end as utm_source,
        cast(null as varchar) as utm_medium,
        case when k % 3 = 2 then 'c' || cast(k % 5 as varchar) end as utm_campaign,
        k % 3 <> 0 as has_utm
    from te""")
def utm_fields(spark, folder):
    return enrich.utm_fields(raw_events(spark, folder)).select(
        "event_id", "utm_source", "utm_medium", "utm_campaign", "has_utm")


@query("company_identifier", f"""
    select event_id, ip_address, h as company_identifier from te join (
        select part, {sql_hash32('part')} as h from (
            select distinct split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) as part
            from te)) on part = split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2)""")
def company_identifier(spark, folder):
    return enrich.company_identifier(raw_events(spark, folder)).select(
        "event_id", "ip_address", "company_identifier")


# Campaign ids of two shapes: UUIDs in either case, and text that is none.
@query("valid_uuid_fk", """
    select event_id, case when k % 3 = 0 then '0000AAAA-0000-4000-8000-' || lpad(cast(user_id as varchar), 12, '0')
        end as campaign_id, cast(null as varchar) as message_id
    from te""")
def valid_uuid_fk(spark, folder):
    ev = raw_events(spark, folder)
    user = F.regexp_extract("session_id", "s([0-9]+)-", 1)
    k = F.get_json_object("data", "$.currentTime").cast("int")
    value = F.when(k % 3 == 0, F.concat(F.lit("0000AAAA-0000-4000-8000-"), F.lpad(user, 12, "0"))
                   ).otherwise(F.concat(F.lit("campaign-"), user))
    data = F.to_json(F.struct(value.alias("campaign_id"), user.alias("message_id")))
    return enrich.valid_uuid_fk(ev.withColumn("data", data)).select(
        "event_id", "campaign_id", "message_id")


# Owners as a faulty writer might set them: one, both, or none.
OWNERS = ("""case when event_id % 4 in (0, 2) then visitor_id else '' end""",
          """case when event_id % 4 in (1, 2) then 'L1' end""")


@query("owner_check", f"""
    select event_id, (coalesce(w, '') <> '') <> (coalesce(l, '') <> '') as valid from (
        select event_id, {OWNERS[0]} as w, {OWNERS[1]} as l from te)""")
def owner_check(spark, folder):
    ev = raw_events(spark, folder).select("event_id", F.expr(OWNERS[0]).alias("web_visitor_id"),
                                          F.expr(OWNERS[1]).alias("lead_id"))
    good, bad = enrich.owner_check(ev)
    return (good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
            .select("event_id", "valid"))


@query("default_channel", """
    select event_id, case k % 6 when 0 then 'direct' when 1 then 'organic_search_google'
        when 2 then 'social_linkedin' when 3 then 'referral_www.pinterest.com'
        when 4 then 'internal' else 'referral_blog.partner.org' end as channel
    from te""")
def default_channel(spark, folder):
    return enrich.default_channel(raw_events(spark, folder)).select("event_id", "channel")


@query("local_time_features", """
    select event_id, cast(hour(l) as integer) as local_hour, cast(dayofweek(l) as integer) as local_weekday,
        dayofweek(l) in (0, 6) as is_weekend,
        dayofweek(l) between 1 and 5 and hour(l) >= 9 and hour(l) < 17 as is_business_hours
    from (select event_id, ts - interval 5 hour as l from te)""")
def local_time_features(spark, folder):
    # New York is five hours behind UTC in the months of the sample.
    return enrich.local_time_features(raw_events(spark, folder), F.lit("America/New_York")).select(
        "event_id", "local_hour", "local_weekday", "is_weekend", "is_business_hours")


@query("page_intent_flags", """
    select event_id, url like '%/pricing%' as viewed_pricing, url like '%/demo%' as requested_demo,
        type = 'form_submit' as submitted_form, url like '%/case-stud%' as viewed_case_study,
        url like '%/product%' as viewed_product
    from te""")
def page_intent_flags(spark, folder):
    return enrich.page_intent_flags(events(spark, folder)).select(
        "event_id", "viewed_pricing", "requested_demo", "submitted_form", "viewed_case_study",
        "viewed_product")


@query("lead_profile_fields", """
    select lead_id, nullif(first_name, '') as first_name, last_name,
        case when first_name <> '' and last_name is not null then first_name || ' ' || last_name end as person_name,
        coalesce(nullif(work_email, ''), personal_email) as email,
        coalesce(company_website, split_part(coalesce(nullif(work_email, ''), personal_email), '@', 2)) as domain,
        company_name as company
    from leads""")
def lead_profile_fields(spark, folder):
    return enrich.lead_profile_fields(samples.leads(spark, folder)).select(
        "lead_id", "first_name", "last_name", "person_name", "email", "domain", "company")


@query("name_fallback", """
    select lead_id, coalesce(nullif(first_name, ''), split_part(person_name, ' ', 1)) as first_name,
        coalesce(last_name, substr(person_name, strpos(person_name, ' ') + 1)) as last_name
    from leads""")
def name_fallback(spark, folder):
    return enrich.name_fallback(samples.leads(spark, folder)).select(
        "lead_id", "first_name", "last_name")


@query("split_work_personal_email", """
    select lead_id, case when email like '%@gmail.com' then email end as personal_email,
        case when email not like '%@gmail.com' then email end as work_email
    from (select lead_id, coalesce(nullif(work_email, ''), personal_email) as email from leads)""")
def split_work_personal_email(spark, folder):
    leads = enrich.lead_profile_fields(samples.leads(spark, folder)).select("lead_id", "email")
    return enrich.split_work_personal_email(leads).select("lead_id", "personal_email", "work_email")


@query("scrub_form_fields", """
    select event_id,
        case when email is null then 'comment,workEmail' else
            'comment,workEmail_md5,workEmail_sha1,workEmail_sha256' end as field_names,
        email is not null as has_email, sha256(email) as email_hash,
        split_part(email, '@', 2) as email_domain, left(data, 100) as comment,
        case when email is null then null else md5(email) end as email_md5
    from te where type = 'form_submit'""")
def scrub_form_fields(spark, folder):
    forms = events(spark, folder).filter("type = 'form_submit'").withColumn("fields", F.create_map(
        F.lit("workEmail"), F.coalesce(payload(F.col("data"), "email"), F.lit("none")),
        F.lit("comment"), F.col("data")))
    out = enrich.scrub_form_fields(forms)
    return out.select(
        "event_id", F.array_join(F.sort_array("field_names"), ",").alias("field_names"), "has_email",
        "email_hash", "email_domain", F.try_element_at("clean_fields", F.lit("comment")).alias("comment"),
        F.try_element_at("clean_fields", F.lit("workEmail_md5")).alias("email_md5"))


FOUND_SQL = """
    select distinct source, row_id, lower(trim(unnest(regexp_extract_all(text,
        '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')))) as email from (
        select 'documents' as source, cast(doc_id as varchar) as row_id, text from documents
        union all select 'conversations', cast(conv_id as varchar) || ':' || cast(turn as varchar), text
        from conversations
        union all select 'leads', lead_id, '{"m":"' || coalesce(nullif(work_email, ''), personal_email) || '"}'
        from leads)"""


def found_emails(spark, folder):
    docs = enrich.extract_emails(samples.raw(spark, folder, "documents"), "doc_id", "text", "documents")
    talk = samples.raw(spark, folder, "conversations").withColumn(
        "row_id", F.concat_ws(":", "conv_id", "turn"))
    # Lead addresses as JSON text with an escaped @, and percent-encoded.
    leads = enrich.lead_profile_fields(samples.leads(spark, folder))
    hidden = F.when(F.length("lead_id") % 2 == 0, F.concat(
        F.lit('{"m":"'), F.replace("email", F.lit("@"), F.lit("\\u0040")), F.lit('"}'))
    ).otherwise(F.concat(F.lit("m="), F.replace("email", F.lit("@"), F.lit("%40"))))
    return (docs.unionByName(enrich.extract_emails(talk, "row_id", "text", "conversations"))
            .unionByName(enrich.extract_emails(leads.withColumn("t", hidden), "lead_id", "t", "leads")))


@query("extract_emails", FOUND_SQL)
def extract_emails(spark, folder):
    return found_emails(spark, folder)


@query("hash_emails", f"""
    select sha256(email) as sha256, sha1(email) as sha1, md5(email) as md5,
        split_part(email, '@', 2) as email_domain, count(*) as occurrences,
        string_agg(distinct source, ',' order by source) as sources
    from ({FOUND_SQL}) group by email""")
def hash_emails(spark, folder):
    return enrich.hash_emails(found_emails(spark, folder)).withColumn(
        "sources", F.array_join("sources", ","))


@query("extract_video_id", """
    select event_id, case when event_id % 5 < 4 then 'vid' || cast(k % 3 as varchar) end as video_id
    from te""")
def extract_video_id(spark, folder):
    ev = raw_events(spark, folder)
    vid = payload(F.col("data"), "videoId")
    n = F.col("event_id") % 5
    link = (F.when(n == 0, F.concat(F.lit("https://www.youtube.com/embed/"), vid, F.lit("?rel=0")))
            .when(n == 1, F.concat(F.lit("https://youtu.be/"), vid))
            .when(n == 2, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), vid, F.lit("&x=1")))
            .when(n == 3, F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), vid, F.lit("/a")))
            .otherwise(F.concat(F.lit("https://video.example.com/"), vid)))
    return enrich.extract_video_id(ev.withColumn("url", link)).select("event_id", "video_id")


@query("device_fingerprint", f"""
    select event_id, {sql_hash32("coalesce(user_agent, '') || '|en-US|1920x' || cast(1080 + user_id % 3 as varchar) || '|24|300|true|true|Linux'")} as device_fingerprint
    from te""")
def device_fingerprint(spark, folder):
    ev = raw_events(spark, folder)
    user = F.regexp_extract("session_id", "s([0-9]+)-", 1).cast("long")
    return enrich.device_fingerprint(ev.withColumns({
        "language": F.lit("en-US"), "screen_width": F.lit(1920),
        "screen_height": (F.lit(1080) + user % 3), "color_depth": F.lit(24),
        "timezone_offset": F.lit(300), "has_session_storage": F.lit(True),
        "has_local_storage": F.lit(True), "platform": F.lit("Linux"),
    })).select("event_id", "device_fingerprint")


IDENTITY_SQL = f"""
    select substr(sha256(email || '-{CAMPAIGN}'), 1, 8) as short_id, lead_id, email,
        nullif(first_name, '') as first_name, last_name, company_name as company,
        '{CAMPAIGN}' as campaign_id, 'Winter' as campaign_name,
        timestamp '2024-01-10 00:00:00' as created_at, timestamp '2024-04-09 00:00:00' as expires_at
    from (select *, coalesce(nullif(work_email, ''), personal_email) as email from leads)"""


def campaign_leads(spark, folder):
    return (enrich.lead_profile_fields(samples.leads(spark, folder))
            .select("lead_id", "email", "first_name", "last_name", "company"))


def identities(spark, folder):
    return campaigns.create_identities(campaign_leads(spark, folder), CAMPAIGN, "Winter",
                                       "2024-01-10 00:00:00")


@query("create_identities", f"select * exclude (lead_id) from ({IDENTITY_SQL})")
def create_identities(spark, folder):
    return identities(spark, folder).drop("visitor_id", "sequence_step")


@query("deterministic_tracking_id", f"select email, short_id from ({IDENTITY_SQL})")
def deterministic_tracking_id(spark, folder):
    # Case and blanks must not matter.
    noisy = campaign_leads(spark, folder).withColumn("email", F.concat(
        F.lit(" "), F.upper("email"), F.lit(" ")))
    out = campaigns.create_identities(noisy, CAMPAIGN, "Winter", "2024-01-10 00:00:00")
    return out.select(F.lower(F.trim("email")).alias("email"), "short_id")


# All ids share one space of eight digits, so every lead is given its id in each of a season's campaigns.
CAMPAIGNS_OF_SEASON = 200
IDS_PER_TASK = 2_000_000


@query("tracking_id_collisions", f"""
    select short_id, count(distinct email) as emails from (
        select email, substr(sha256(email || '-c' || cast(n as varchar)), 1, 8) as short_id
        from (select distinct coalesce(nullif(work_email, ''), personal_email) as email,
            unnest(range({CAMPAIGNS_OF_SEASON})) as n from leads))
    group by short_id having count(distinct email) > 1""")
def tracking_id_collisions(spark, folder):
    # Addresses once and numbered, then dealt out, as each makes many ids and one small file holds many addresses.
    enable_checkpoints(spark)
    known = (campaign_leads(spark, folder).select(emails.normal_email(F.col("email")).alias("email"))
             .filter("email is not null").distinct().withColumn("person", F.monotonically_increasing_id()).checkpoint())
    parts = max(spark.sparkContext.defaultParallelism, -(-known.count() * CAMPAIGNS_OF_SEASON // IDS_PER_TASK))
    season = F.explode(F.sequence(F.lit(0), F.lit(CAMPAIGNS_OF_SEASON - 1)))
    ids = known.repartition(parts).select("email", "person", season.alias("n")).select(
        "person", emails.tracking_id_for(F.col("email"), F.concat(F.lit("c"), F.col("n").cast("string"))).alias("short_id"))
    return campaigns.tracking_id_collisions(ids, F.col("person"), parts)


@query("tracking_urls", f"""
    select email, 'https://www.example.com/go?i=' || short_id || '&to=%2Fdemo%3Fx%3D1' as tracking_url
    from ({IDENTITY_SQL})""")
def tracking_urls(spark, folder):
    return identities(spark, folder).select("email", urls.tracking_url(
        "https://www.example.com", F.col("short_id"), "/demo?x=1").alias("tracking_url"))


STATUS_SQL = """case status when 'valid' then 'verified' when 'invalid' then 'invalid'
    when 'catch-all' then 'accept_all' else 'unverified' end"""


@query("map_email_status", f"select email, status, {STATUS_SQL} as email_status from validations")
def map_email_status(spark, folder):
    return enrich.map_email_status(samples.email_validations(spark, folder))


AUDIENCES = {
    "returning": "total_sessions>2", "hot": "engagement_level=hot", "pricing": "viewed_pricing",
    "never": "total_sessions>=1", "known": "first_name", "machinery": "company_industry=MACHINERY",
}


@query("audience_filter", f"""
    select tracking_id, total_sessions from ({PROFILES_SQL}) where total_sessions > 2""")
def audience_filter(spark, folder):
    return audiences.audience_filter(profile_table(spark, folder), "total_sessions>2").select(
        "tracking_id", "total_sessions")


@query("audience_assignment", f"""
    with p as ({PROFILES_SQL})
    select tracking_id, 'returning' as audience from p where total_sessions > 2
    union all select tracking_id, 'hot' from p where engagement_level = 'hot'
    union all select tracking_id, 'pricing' from p where viewed_pricing
    union all select tracking_id, 'known' from p where first_name is not null
    union all select tracking_id, 'machinery' from p where company_industry = 'MACHINERY'""")
def audience_assignment(spark, folder):
    return audiences.audience_assignment(profile_table(spark, folder), AUDIENCES, "tracking_id")


_TEXT = ["first_name", "last_name", "person_name", "email", "phone", "company_name", "company_description",
         "company_website", "company_linkedin", "domain", "job_title", "engagement_level"]
_TEXT_FROM = {"company": "company_name", "linkedin": "linkedin_url", "company_size": "company_headcount",
              "revenue": "company_revenue", "industry": "company_industry", "seniority": "job_seniority",
              "department": "job_department", "visitor_id": "tracking_id", "campaign_id": "campaigns[0].campaign_id",
              "campaign_name": "campaigns[0].campaign_name"}
_OTHER_FROM = {"intent_score": "intent_score", "total_visits": "total_sessions", "total_pageviews": "total_pageviews",
               "is_first_visit": "is_first_visit", "viewed_pricing": "viewed_pricing", "submitted_form": "submitted_form"}
VARIABLES_SQL = f"""
    with p as (select * replace (from_json(campaigns, '[{{"campaign_id":"VARCHAR","campaign_name":"VARCHAR"}}]') as campaigns),
            cast(null as double) as intent_score from ({PROFILES_SQL})),
    v as ({' union all '.join(
        f"select tracking_id, '{n}' as name, cast({c} as varchar) as value from p"
        for n, c in {**dict(zip(_TEXT, _TEXT, strict=True)), **_TEXT_FROM, **_OTHER_FROM}.items()).replace("campaigns[0]", "campaigns[1]")})
    select * from v where value is not null"""


@query("export_variables", VARIABLES_SQL)
def export_variables(spark, folder):
    profiles = profile_table(spark, folder).withColumn("visitor_id", F.col("tracking_id"))
    out = audiences.export_variables(profiles, "tracking_id", absent=("intent_score",))
    return out.select("tracking_id", F.explode("variables").alias("name", "value"))


@query("unexpired_only", f"""
    select short_id, email from ({IDENTITY_SQL})
    where timestamp '2024-01-10 00:00:00' + to_days(cast(length(email) - 6 as integer)) > timestamp '{AS_OF}'""")
def unexpired_only(spark, folder):
    ids = identities(spark, folder).withColumn("expires_at", F.timestamp_micros(
        F.unix_micros("created_at") + (F.length("email") - 6) * F.lit(86_400_000_000)))
    return enrich.unexpired_only(ids, AS_OF).select("short_id", "email")


@query("retention_filter", f"""
    select event_id, cast(ts as date) as event_date from te
    where cast(ts as date) >= date '2024-01-31' - 10""")
def retention_filter(spark, folder):
    ev = raw_events(spark, folder).withColumn("event_date", F.to_date("ts"))
    return enrich.retention_filter(ev, AS_OF, days=10).select("event_id", "event_date")


# Origins: the referrer's scheme and host.
@query("origin_allowlist", """
    select event_id, origin from (
        select event_id, regexp_extract(referrer, '^https?://[^/]+') as origin from te
        where referrer is not null)
    where origin in ('https://www.example.com', 'https://blog.partner.org')""")
def origin_allowlist(spark, folder):
    ev = raw_events(spark, folder).select(
        "event_id", filled(F.regexp_extract("referrer", "^https?://[^/]+", 0)).alias("origin"))
    return enrich.origin_allowlist(ev, ["https://*.partner.org", " https://www.example.com "])
