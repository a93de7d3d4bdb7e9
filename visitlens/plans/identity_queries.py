"""Named queries: identity, owners, snapshots and deletion."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlens.functions import emails
from visitlens.operators import campaigns, enrich, identity, profiles, stitching, upserts
from visitlens.operators.periods import in_period
from visitlens.plans.behavior_queries import ROLLUP_SQL
from visitlens.plans.catalog import events, query, raw_events
from visitlens.plans.event_queries import STATUS_SQL
from visitlens.plans.profile_queries import CLICKS_SQL, CONTACT, PROFILES_SQL, profile_table, scored_sql
from visitlens.session import enable_checkpoints, new_folder
from visitlens.sources import samples, writers
from visitlens.sources.group_table import GroupTable
from visitlens.sources.session_table import SessionTable, activity_log

AS_OF = samples.AS_OF



def raw_typed(spark, folder):
    return enrich.typed(raw_events(spark, folder))


SIGNALS_SQL = """
    select batch_id, min(ts) as ts,
        coalesce(arg_min_null(visitor_id, pos), arg_min_null(browser_id, pos), arg_min(device_fingerprint, pos))
            as visitor_id,
        arg_min_null(tracking_id, pos) as tracking_id, arg_min(device_fingerprint, pos) as device_fingerprint,
        arg_min_null(browser_id, pos) as browser_id,
        arg_min(email, pos) filter (email is not null) as email
    from te group by batch_id"""


def signals(spark, folder):
    return identity.batch_identity_signal(raw_typed(spark, folder))


@query("batch_identity_signal", SIGNALS_SQL)
def batch_identity_signal(spark, folder):
    return signals(spark, folder).select(
        "batch_id", "ts", "visitor_id", "tracking_id", "device_fingerprint", "browser_id", "email")


BY_EMAIL = """select email, min(lead_id) as lead_id from (
    select lead_id, nullif(work_email, '') as email from leads
    union all select lead_id, personal_email from leads) where email is not null group by email"""
BY_TRACKING = "select tracking_id, min(lead_id) as lead_id from leads where tracking_id <> '' group by 1"
RESOLVED_SQL = f"""
    select s.*, coalesce(t.lead_id, e.lead_id) as lead_id,
        case when t.lead_id is not null then 'tracking_id' when e.lead_id is not null then 'email' end as resolved_by
    from ({SIGNALS_SQL}) s left join ({BY_TRACKING}) t on t.tracking_id = s.tracking_id
    left join ({BY_EMAIL}) e on e.email = s.email"""


@query("resolve_lead", f"select batch_id, lead_id, resolved_by from ({RESOLVED_SQL})")
def resolve_lead(spark, folder):
    return identity.resolve_lead(signals(spark, folder), samples.leads(spark, folder)).select(
        "batch_id", "lead_id", "resolved_by")


STATUS = f"""
    select r.*, coalesce(v.is_identified, false) as is_identified,
        case when v.is_identified then v.lead_id end as known_lead_id
    from ({RESOLVED_SQL}) r left join visitors v on v.visitor_id = r.visitor_id"""


@query("visitor_status", f"select batch_id, visitor_id, is_identified, known_lead_id from ({STATUS})")
def visitor_status(spark, folder):
    return identity.visitor_status(signals(spark, folder), samples.web_visitors(spark, folder)).select(
        "batch_id", "visitor_id", "is_identified", "known_lead_id")


NEW_ID = "'lead-' || substr(sha256({0}), 1, 32)"
FOUND_SQL = f"""
    select *, case when tracking_id is not null then lead_id
        when email is not null then coalesce(known_lead_id, lead_id) end as found from ({STATUS})"""
NEW_LEADS_SQL = """
    tracked as (select tracking_id, arg_min(email, (ts, batch_id)) filter (email is not null) as work_email,
        min(ts) as identified_at from open where tracking_id is not null group by tracking_id),
    addressed as (select email as work_email, min(ts) as identified_at from open
        where tracking_id is null and email is not null
            and email not in (select work_email from tracked where work_email is not null)
        group by email),
    created as (
        select """ + NEW_ID.format("tracking_id") + """ as lead_id, tracking_id, work_email, identified_at from tracked
        union all select """ + NEW_ID.format("work_email") + """, null, work_email, identified_at from addressed)"""
OWNERS_SQL = f"""
    with f as ({FOUND_SQL}), open as (select * from f where found is null), {NEW_LEADS_SQL}
    select batch_id, coalesce(found, case when tracking_id is not null then {NEW_ID.format('tracking_id')}
            when email is not null then (select min(c.lead_id) from created c where c.work_email = f.email) end)
            as lead_id,
        case when tracking_id is null and email is null then visitor_id end as web_visitor_id,
        case when tracking_id is not null then 'tracking_id' when email is null then 'anonymous'
            when known_lead_id is not null then 'known_visitor' else 'email_capture' end as owner_method,
        found is null and (tracking_id is not null or email is not null) as is_new_lead
    from f"""


@query("batch_owners", OWNERS_SQL)
def batch_owners(spark, folder):
    enable_checkpoints(spark)
    return identity.batch_owners(signals(spark, folder).checkpoint(), samples.leads(spark, folder),
                                 samples.web_visitors(spark, folder))


def owned_events(spark, folder):
    return identity.assign_owner(raw_typed(spark, folder), samples.leads(spark, folder),
                                 samples.web_visitors(spark, folder))


OWNED_SQL = f"select te.*, o.lead_id, o.web_visitor_id from te join ({OWNERS_SQL}) o using (batch_id)"


@query("assign_owner", f"select event_id, lead_id, web_visitor_id from ({OWNED_SQL})")
def assign_owner(spark, folder):
    return owned_events(spark, folder).select("event_id", "lead_id", "web_visitor_id")


RECENT = "timestamp '2024-01-30 12:00:00'"


@query("leads_to_sync", f"""
    select lead_id, tracking_id from leads where tracking_id is not null and (
        updated_at >= {RECENT} - interval 10 minute or lead_id in (
            select 'L' || cast(user_id as varchar) from te
            where visitor_id is not null and ts >= {RECENT} - interval 10 minute))""")
def leads_to_sync(spark, folder):
    owned = events(spark, folder).withColumn("lead_id", F.concat(
        F.lit("L"), F.substring("visitor_id", 2, 20)))
    return identity.leads_to_sync(samples.leads(spark, folder), owned, "2024-01-30 12:00:00").select(
        "lead_id", "tracking_id")


@query("new_visitors", """
    select distinct visitor_id from te where visitor_id is not null
        and visitor_id not in (select visitor_id from visitors)""")
def new_visitors(spark, folder):
    return identity.new_visitors(events(spark, folder), samples.web_visitors(spark, folder))


@query("sync_candidates", f"""
    select lead_id from leads where created_at >= timestamp '{AS_OF}' - interval 5 day
        or tracking_id in (select visitor_id from te where visitor_id is not null)""")
def sync_candidates(spark, folder):
    return identity.sync_candidates(samples.leads(spark, folder), events(spark, folder), AS_OF,
                                    days=5).select("lead_id")


# The identity snapshot holds the leads of a campaign, the personal one those that were seen.
CASCADE_IDS = """select distinct visitor_id from te where visitor_id is not null
    union select tracking_id from leads where tracking_id <> ''
    union select 'x' || cast(c_custkey as varchar) from customer"""
_LEAD_SQL = {
    "first_name": "nullif({0}.first_name, '')", "last_name": "{0}.last_name",
    "person_name": "case when nullif({0}.first_name, '') is not null and {0}.last_name is not null"
                   " then {0}.first_name || ' ' || {0}.last_name end",
    "email": "coalesce(nullif({0}.work_email, ''), {0}.personal_email)", "company_name": "{0}.company_name",
    "domain": "coalesce({0}.company_website, split_part(coalesce(nullif({0}.work_email, ''), {0}.personal_email), '@', 2))",
    "company_industry": "{0}.company_industry", "company_revenue": "{0}.company_revenue",
    **{c: "nullif({0}." + c + ", '')" for c in profiles.SERVED}}


def _cascade_field(name: str) -> str:
    return (f"case when source in ('identity', 'personalization') then p.{name} when source = 'lead' then "
            f"{_LEAD_SQL[name].format('l')} when source = 'visitor_lead' then {_LEAD_SQL[name].format('vl')} end as {name}")


CASCADE_SQL = f"""
    with p as ({PROFILES_SQL}), ids as ({CASCADE_IDS}), r as (
    select i.visitor_id,
        case when p.is_in_campaign then 'identity' when p.has_visited then 'personalization'
            when l.lead_id is not null then 'lead'
            when v.is_identified and vl.lead_id is not null then 'visitor_lead'
            when v.is_identified then 'lead_missing'
            when v.visitor_id is not null then 'anonymous' else 'unknown' end as source,
        l, vl, p, v
    from ids i left join leads l on l.tracking_id = i.visitor_id
    left join visitors v on v.visitor_id = i.visitor_id left join leads vl on vl.lead_id = v.lead_id
    left join p on p.tracking_id = i.visitor_id)
    select visitor_id, source, source in ('identity', 'personalization', 'lead', 'visitor_lead') as personalized,
        {', '.join(map(_cascade_field, _LEAD_SQL))},
        case when source in ('lead', 'visitor_lead') then 0.0::double end as intent_score,
        case when source in ('identity', 'personalization') then p.engagement_level
            when source in ('lead', 'visitor_lead') then 'new' end as engagement_level,
        case when source in ('identity', 'personalization') then p.is_first_visit
            when source = 'lead' then true end as is_first_visit,
        case when source in ('identity', 'personalization') then p.total_sessions
            when source = 'lead' then 0 when source = 'visitor_lead' then v.total_sessions end as total_sessions,
        case when source in ('identity', 'personalization') then p.total_pageviews
            when source = 'lead' then 0 when source = 'visitor_lead' then cast(v.total_pageviews as bigint) end
            as total_pageviews
    from r"""


@query("resolve_profile", CASCADE_SQL)
def resolve_profile(spark, folder):
    p = profile_table(spark, folder)
    ids_snapshot = writers.profile_snapshot(p.filter("is_in_campaign"), "tracking_id", AS_OF)
    personal = writers.profile_snapshot(p.filter("has_visited"), "tracking_id", AS_OF)
    strangers = (samples.raw(spark, folder, "customer")
                 .select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("visitor_id")))
    leads = samples.leads(spark, folder)
    tracked = leads.filter("tracking_id <> ''").select(F.col("tracking_id").alias("visitor_id"))
    wanted = events(spark, folder).select("visitor_id").unionByName(strangers).unionByName(tracked)
    return identity.resolve_profile(wanted, ids_snapshot, personal, leads, samples.web_visitors(spark, folder))


# Each user's visitor row carries one of the three hashes of a lead's address.
HASHED_VISITORS_SQL = f"""
    select visitor_id, n, e from (
        select v.visitor_id, cast(substr(v.visitor_id, 2) as bigint) as n, {CONTACT} as e
        from visitors v join leads l on l.lead_id = 'L' || substr(v.visitor_id, 2)
        where not v.is_identified)"""


def hashed_visitors(spark, folder):
    v = samples.web_visitors(spark, folder)
    leads = samples.leads(spark, folder).select(
        F.concat(F.lit("v"), F.substring("lead_id", 2, 20)).alias("visitor_id"),
        F.expr(CONTACT).alias("email"))
    n = F.substring("visitor_id", 2, 20).cast("long")
    return v.join(leads, "visitor_id", "left").select(
        "visitor_id", "is_identified",
        F.when(n % 4 == 0, F.sha2("email", 256)).when(n % 4 == 3, F.lit("no such hash")).alias("sha256"),
        F.when(n % 4 == 1, F.sha1("email")).alias("sha1"),
        F.when(n % 4 != 1, F.md5("email")).alias("md5"))


DEANON_SQL = f"""
    select visitor_id, 'L' || substr(visitor_id, 2) as lead_id,
        case n % 4 when 0 then 'sha256' when 1 then 'sha1' else 'md5' end as matched_by
    from ({HASHED_VISITORS_SQL})"""


def matched(spark, folder):
    return identity.deanonymize(hashed_visitors(spark, folder), samples.leads(spark, folder))


@query("deanonymize", DEANON_SQL)
def deanonymize(spark, folder):
    return matched(spark, folder)


LINKED_SQL = f"""
    select session_id, te.visitor_id as original_visitor_id, any_value(m.lead_id) as identified_lead_id,
        any_value(matched_by) as id_method, count(*) as event_count, max(ts) as identified_at
    from te join ({DEANON_SQL}) m on m.visitor_id = te.visitor_id group by session_id, te.visitor_id"""


@query("link_sessions", LINKED_SQL)
def link_sessions(spark, folder):
    return identity.link_sessions(events(spark, folder), matched(spark, folder))


@query("backfill_events", f"""
    select event_id, case when event_id % 10 = 0 then 'L0' else m.identified_lead_id end as lead_id,
        case when event_id % 10 <> 0 and m.identified_lead_id is null then te.visitor_id end as web_visitor_id
    from te left join ({LINKED_SQL}) m on m.session_id = te.session_id
        and m.original_visitor_id = te.visitor_id""")
def backfill_events(spark, folder):
    # Every tenth event has a lead already.
    ten = F.col("event_id") % 10 == 0
    ev = events(spark, folder).withColumns({
        "lead_id": F.when(ten, F.lit("L0")), "web_visitor_id": F.when(~ten, F.col("visitor_id"))})
    links = identity.link_sessions(events(spark, folder), matched(spark, folder))
    return identity.backfill_events(ev, links).select("event_id", "lead_id", "web_visitor_id")


STITCHED_SQL = """
    with recursive l as (
        select distinct 'v' || cast(user_id as varchar) as record, 'd' as kind, device_fingerprint as value from te
        union select distinct 'v' || cast(user_id as varchar), 'b', browser_id from te where browser_id is not null),
    pairs as (select distinct a.record as x, b.record as y from l a join l b using (kind, value)),
    reach as (select x, y from pairs union select r.x, p.y from reach r join pairs p on p.x = r.y)
    select x as record, min(y) as group_id from reach group by x"""


@query("stitch_identities", STITCHED_SQL)
def stitch_identities(spark, folder):
    return stitching.stitch_identities(identity_links(events(spark, folder)))


# The same groups from links that come in by thirds of the month.
@query("stitch_over_time", STITCHED_SQL)
def stitch_over_time(spark, folder):
    groups = GroupTable(spark, new_folder(spark, "groups"), buckets=4)
    for n, batch in enumerate(_batches(spark, folder)):
        groups.add(identity_links(batch), n)
    return groups.read()


def identity_links(ev):
    """Devices and browsers of each user's events."""
    record = F.concat(F.lit("v"), F.regexp_extract("session_id", "s([0-9]+)-", 1))
    keys = F.explode(F.array(
        F.struct(F.lit("d").alias("kind"), F.col("device_fingerprint").alias("value")),
        F.struct(F.lit("b").alias("kind"), F.col("browser_id").alias("value"))))
    return ev.select(record.alias("record"), keys.alias("_k")).select("record", "_k.*")


@query("email_click_attribution", f"""
    select i.short_id, i.email, coalesce(c.clicks, 0) as clicks, first_click_at, last_clicked_at
    from (select tracking_id as short_id, {CONTACT} as email from leads where tracking_id <> '') i
    left join ({CLICKS_SQL}) c on c.tracking_id = i.short_id""")
def email_click_attribution(spark, folder):
    ids = (samples.leads(spark, folder).filter("tracking_id <> ''")
           .select(F.col("tracking_id").alias("short_id"), F.expr(CONTACT).alias("email"),
                   F.lit(0).alias("clicks"), F.lit(None).cast("timestamp").alias("last_clicked_at")))
    return campaigns.email_click_attribution(ids, events(spark, folder)).select(
        "short_id", "email", "clicks", "first_click_at", "last_clicked_at")


VALIDATED_SQL = f"""
    select lead_id, case when v.email is null then email_status else {STATUS_SQL} end as email_status
    from leads left join validations v
        on lower(trim(v.email)) = {CONTACT}"""


def validated(spark, folder):
    results = enrich.map_email_status(samples.email_validations(spark, folder))
    leads = samples.leads(spark, folder).withColumn("email", F.expr(CONTACT))
    return upserts.update_email_status(leads, results).select("lead_id", "email_status")


@query("update_email_status", VALIDATED_SQL)
def update_email_status(spark, folder):
    return validated(spark, folder)


# The verification round: results for the unverified leads only.
@query("apply_email_validation", f"""
    select lead_id, case when email_status = 'unverified' then {STATUS_SQL} else email_status end as email_status
    from leads join validations v on lower(trim(v.email)) = {CONTACT}""")
def apply_email_validation(spark, folder):
    leads = samples.leads(spark, folder).withColumn("email", F.expr(CONTACT))
    asked = leads.filter("email_status = 'unverified'").select(F.col("email").alias("_asked"))
    results = samples.email_validations(spark, folder)
    answered = results.join(asked, emails.normal_email(F.col("email")) == F.col("_asked"), "left_semi")
    return upserts.update_email_status(leads, enrich.map_email_status(answered)).select(
        "lead_id", "email_status")


@query("upsert_web_visitors", f"""
    select coalesce(v.visitor_id, e.visitor_id) as visitor_id,
        case when v.visitor_id is null then e.d else v.device_fingerprint end as device_fingerprint,
        case when v.visitor_id is null then e.b end as browser_id,
        least(v.first_seen_at, e.f) as first_seen_at, greatest(v.last_seen_at, e.l) as last_seen_at,
        coalesce(v.is_identified, false) as is_identified, v.lead_id
    from visitors v full join (
        select visitor_id, min(ts) as f, max(ts) as l, arg_min(device_fingerprint, (ts, event_id)) as d,
            arg_min(browser_id, (ts, event_id)) filter (browser_id is not null) as b
        from te where visitor_id is not null and ts >= timestamp '{samples.CUT}' group by visitor_id) e
        on e.visitor_id = v.visitor_id""")
def upsert_web_visitors(spark, folder):
    fresh = events(spark, folder).filter(F.col("ts") >= F.lit(samples.CUT).cast("timestamp"))
    return upserts.upsert_web_visitors(samples.web_visitors(spark, folder), fresh).select(
        "visitor_id", "device_fingerprint", "browser_id", "first_seen_at", "last_seen_at",
        "is_identified", "lead_id")


@query("upsert_leads", f"""
    with open as (select * from ({RESOLVED_SQL}) where lead_id is null
        and (tracking_id is not null or email is not null)), {NEW_LEADS_SQL}
    select lead_id, tracking_id, work_email, null as identified_at from leads
    union all select lead_id, tracking_id, work_email, identified_at from created""")
def upsert_leads(spark, folder):
    return upserts.upsert_leads(samples.leads(spark, folder), signals(spark, folder)).select(
        "lead_id", "tracking_id", "work_email", "identified_at")


# A patch for every third lead: new title for half of them, a new address for all.
@query("update_lead_identity", """
    select * exclude (n) replace (
        case when n % 9 = 0 then 'patched' || cast(n as varchar) || '@new.org' else work_email end as work_email,
        case when n % 3 = 0 and n % 9 <> 0 then 'patched' || cast(n as varchar) || '@gmail.com'
            else personal_email end as personal_email,
        case when n % 6 = 0 then 'Director' else job_title end as job_title)
    from (select *, cast(substr(lead_id, 2) as bigint) as n from leads)""")
def update_lead_identity(spark, folder):
    leads = samples.leads(spark, folder)
    n = F.substring("lead_id", 2, 20).cast("long")
    patches = leads.filter(n % 3 == 0).select(
        "lead_id", F.concat(F.lit("patched"), n.cast("string"), F.when(
            n % 9 == 0, "@new.org").otherwise("@gmail.com")).alias("email"),
        F.when(n % 6 == 0, "Director").otherwise("").alias("job_title"))
    return upserts.update_lead_identity(leads, patches)


@query("identify_visitors", f"""
    select v.visitor_id, case when take then s.lead_id else v.lead_id end as lead_id,
        case when take then s.ts else v.identified_at end as identified_at,
        v.is_identified or take as is_identified
    from (select v.*, s, s.ts is not null and (not v.is_identified or coalesce(s.ts < v.identified_at, false)) as take
        from visitors v left join (
            select visitor_id, min(ts) as ts, arg_min(lead_id, (ts, lead_id)) as lead_id
            from ({RESOLVED_SQL}) where lead_id is not null group by visitor_id) s
            on s.visitor_id = v.visitor_id) v""")
def identify_visitors(spark, folder):
    found = identity.resolve_lead(signals(spark, folder), samples.leads(spark, folder)).filter(
        "lead_id is not null").select("visitor_id", "lead_id", "ts", F.col("resolved_by").alias("method"))
    return upserts.identify_visitors(samples.web_visitors(spark, folder), found).select(
        "visitor_id", "lead_id", "identified_at", "is_identified")


@query("attach_email_hashes", f"""
    select v.visitor_id, case when not v.is_identified then sha256(s.email) end as sha256,
        case when not v.is_identified then md5(s.email) end as md5,
        case when not v.is_identified then split_part(s.email, '@', 2) end as email_domain
    from visitors v left join (select visitor_id, arg_min(email, ts) as email from ({SIGNALS_SQL})
        where email is not null group by visitor_id) s on s.visitor_id = v.visitor_id""")
def attach_email_hashes(spark, folder):
    return upserts.attach_email_hashes(samples.web_visitors(spark, folder), signals(spark, folder)).select(
        "visitor_id", "sha256", "md5", "email_domain")


@query("assign_tracking_ids", f"""
    select lead_id, coalesce(nullif(tracking_id, ''), substr(sha256({CONTACT} || '-default'), 1, 8)) as tracking_id
    from leads""")
def assign_tracking_ids(spark, folder):
    return upserts.assign_tracking_ids(samples.leads(spark, folder)).select("lead_id", "tracking_id")


# The month in three batches; sessions of this gap cross both borders.
BATCHES = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01")]


def _batches(spark, folder):
    ev = events(spark, folder)
    for since, until in BATCHES:
        yield ev.filter((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))


@query("merge_sessions", ROLLUP_SQL)
def merge_sessions(spark, folder):
    table = SessionTable(spark, new_folder(spark, "session-table"), gap_seconds=6 * 3600)
    for n, batch in enumerate(_batches(spark, folder)):
        table.merge(batch, f"batch-{n}")
    return table.read()


@query("merge_profiles", f"select * exclude (age) from ({scored_sql()})")
def merge_profiles(spark, folder):
    log = activity_log(spark, new_folder(spark, "activity"), buckets=4, fold_every=2)
    for n, batch in enumerate(_batches(spark, folder)):
        log.add(profiles.activity_state(in_period(batch, until=AS_OF)), n)
    return profiles.lead_profiles(samples.leads(spark, folder), profiles.activity_of(log.read()), AS_OF)


@query("delete_lead", f"""
    select event_id, lead_id from ({OWNED_SQL}) where lead_id is null or lead_id not in (
        select lead_id from leads where cast(substr(lead_id, 2) as bigint) % 4 = 1)""")
def delete_lead(spark, folder):
    gone = samples.leads(spark, folder).filter(F.substring("lead_id", 2, 20).cast("long") % 4 == 1)
    return upserts.delete_lead(owned_events(spark, folder), gone).select("event_id", "lead_id")
