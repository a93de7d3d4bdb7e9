"""Named queries: readers and writers, by writing a table and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlens.operators import enrich, profiles
from visitlens.plans.catalog import events, query, raw_events, sql_hash32
from visitlens.plans import flows
from visitlens.plans.event_queries import CATEGORY_SQL, IDENTITY_SQL, campaign_leads, identities
from visitlens.plans.identity_queries import OWNED_SQL, OWNERS_SQL, owned_events
from visitlens.plans.profile_queries import (
    HOT_SQL, PROFILES_SQL, profile_table, scored_profiles)
from visitlens.session import new_folder
from visitlens.sources import readers, samples, writers
from visitlens.sources.event_store import EventStore
from visitlens.sources.key_index import KeyIndex
from visitlens.sources.snapshots import PagedSnapshot

AS_OF = samples.AS_OF

# Records per JSON array in the files of ``read_identities``.
ARRAY_RECORDS = 2000

# Batches of users ending in 9 are malformed in every third block of ids.
BROKEN = "user_id % 10 = 9 and (event_id - event_id % 300) % 1000 = 300"


@query("read_event_batches", f"""
    select batch_id, cast(row_number() over (partition by batch_id order by pos) - 1 as integer) as pos,
        date_trunc('milliseconds', max(ts) over (partition by batch_id)) + interval 1 second as sent_at,
        raw_type, date_trunc('milliseconds', ts) as ts, session_id, visitor_id, url, referrer, data
    from te where not ({BROKEN})""")
def read_event_batches(spark, folder):
    path = new_folder(spark, "bodies")
    samples.event_envelopes(spark, folder).write.parquet(path)
    good, _ = readers.parse_event_batches(spark.read.parquet(path))
    return good


# The batches the reader accepts, with times as a body carries them.
RECEIVED = f"""good as (select * replace (date_trunc('milliseconds', ts) as ts),
        date_trunc('milliseconds', max(ts) over (partition by batch_id)) + interval 1 second as sent_at,
        cast(row_number() over (partition by batch_id order by pos) - 1 as integer) as place
    from te where not ({BROKEN}))"""
GOOD_OWNERS = OWNERS_SQL.replace("from te ", "from good ")
INGESTED_SQL = f"""
    with {RECEIVED}, o as ({GOOD_OWNERS}),
    r as (select distinct batch_id as b, {', '.join(f'{e} as {n}' for n, e in samples.REQUEST.items())} from te0)
    select t.batch_id, place as pos, ts, sent_at, sent_at + interval 50 millisecond as received_at, type,
        {CATEGORY_SQL.replace("type", "t.type")} as category,
        first_value(session_id) over (partition by t.batch_id order by place) as session_id, o.lead_id, o.web_visitor_id,
        visitor_id, url, path, true as url_ok, referrer,
        left(data, length(data) - 1) || ',"_originalSessionId":"' || session_id || '"}}' as data,
        {sql_hash32("'10.' || cast(user_id % 25 as varchar)")} as company_identifier,
        case when k % 3 = 1 then 'last' end as utm_source, cast(null as varchar) as utm_medium,
        case when k % 3 = 2 then 'c' || cast(k % 5 as varchar) end as utm_campaign, cast(null as varchar) as utm_term,
        cast(null as varchar) as utm_content, cast(null as varchar) as gclid, cast(null as varchar) as fbclid,
        cast(null as varchar) as campaign_id, cast(null as varchar) as message_id,
        case when k % 3 = 1 then '{{"utm_medium":"","utm_source":"last"}}'
            when k % 3 = 2 then '{{"q":"a b","utm_campaign":"c' || cast(k % 5 as varchar) || '"}}' end as url_parms,
        cast(ts as date) as event_date, {', '.join(f'r.{n}' for n in samples.REQUEST)}
    from good t join o on o.batch_id = t.batch_id join r on r.b = t.batch_id"""


# Every envelope comes twice in the first commit, and a third of the users send theirs again later.
@query("ingest_batches", INGESTED_SQL)
def ingest_batches(spark, folder):
    received = samples.request_envelopes(spark, folder)
    later = received.filter(F.regexp_extract("batch_id", "b([0-9]+)-", 1).cast("long") % 3 == 0)
    store = EventStore(spark, new_folder(spark, "event-store"))
    leads, visitors = samples.leads(spark, folder), samples.web_visitors(spark, folder)
    flows.ingest_batches(received.unionByName(received), leads, visitors, store, "first")
    flows.ingest_batches(later, leads, visitors, store, "again")
    # The order of a map's keys is not fixed; the text is compared in one order.
    params = F.from_json("url_parms", "map<string,string>")
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))
    return store.read().withColumn("url_parms", ordered).drop("event_id", "commit")


@query("rejected_event_batches", f"select distinct batch_id from te where {BROKEN}")
def rejected_event_batches(spark, folder):
    _, bad = readers.parse_event_batches(samples.event_envelopes(spark, folder))
    return bad.select("batch_id")


@query("read_campaign_leads", """
    select coalesce(nullif(work_email, ''), personal_email) as email, nullif(first_name, '') as first_name,
        last_name, company_name as company from leads""")
def read_campaign_leads(spark, folder):
    path = new_folder(spark, "lead-file")
    (campaign_leads(spark, folder)
     .select(F.col("email").alias("Email"), F.col("first_name").alias("First Name"), "last_name",
             F.col("company").alias("Company"))
     .write.csv(path, header=True))
    return readers.read_campaign_leads(spark, path)


@query("read_identities", f"""
    select short_id, email, first_name, last_name, company, campaign_id, campaign_name, created_at, expires_at
    from ({IDENTITY_SQL})""")
def read_identities(spark, folder):
    path = new_folder(spark, "identities")
    record = F.to_json(F.struct(
        F.col("short_id").alias("shortId"), "email", F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"), "company", F.col("campaign_id").alias("campaignId"),
        F.col("campaign_name").alias("campaignName"), F.unix_millis("created_at").alias("createdAt"),
        F.unix_millis("expires_at").alias("expiresAt")))
    # One JSON array per file, of about ARRAY_RECORDS records however many there are.
    made = identities(spark, folder)
    files = made.count() // ARRAY_RECORDS + 1
    (made.groupBy(F.pmod(F.xxhash64("short_id"), F.lit(files)).alias("_p"))
     .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(path))
    return readers.read_identities(spark, path).drop("visitor_id", "sequence_step")


@query("scan_filtered", """
    select lead_id, tracking_id, updated_at from leads
    where email_status = 'unverified' and tracking_id is not null and updated_at >= timestamp '2024-01-05'
        and company_industry in ('MACHINERY', 'FURNITURE')
        and (company_name = 'Company 1' or job_title = 'Manager')
    order by updated_at desc, lead_id limit 100 offset 5""")
def scan_filtered(spark, folder):
    scan = readers.Scan(
        equals={"email_status": "unverified"}, not_null=["tracking_id"],
        at_least={"updated_at": F.lit("2024-01-05").cast("timestamp")},
        within={"company_industry": ["MACHINERY", "FURNITURE"]},
        any_equals={"company_name": "Company 1", "job_title": "Manager"},
        columns=["lead_id", "tracking_id", "updated_at"],
        order=[F.desc("updated_at"), F.asc("lead_id")], limit=100, offset=5)
    return readers.scan_filtered(samples.leads(spark, folder), scan)


@query("write_events", f"select event_id, cast(ts as date) as event_date, lead_id, web_visitor_id from ({OWNED_SQL})")
def write_events(spark, folder):
    path = new_folder(spark, "event")
    writers.write_events(owned_events(spark, folder), path, files_per_day=1)
    return spark.read.parquet(path).select("event_id", "event_date", "lead_id", "web_visitor_id")


@query("write_campaign_urls", f"""
    select email as "Email", coalesce(first_name, '') as "First Name", coalesce(last_name, '') as "Last Name",
        company as "Company", 'https://www.example.com/go?i=' || short_id || '&to=%2Fdemo' as "Tracking URL",
        short_id as "Short ID"
    from ({IDENTITY_SQL})""")
def write_campaign_urls(spark, folder):
    path = new_folder(spark, "links")
    writers.write_campaign_urls(identities(spark, folder), "https://www.example.com", path, "/demo")
    back = spark.read.csv(path, header=True, quote='"', escape='"', emptyValue="")
    return back.na.fill("", ["First Name", "Last Name"])


@query("write_identity_map", f"""
    select short_id, cast(null as varchar) as visitor_id, email, {sql_hash32('lower(trim(email))')} as email_hash,
        first_name, last_name, company, campaign_id, campaign_name, cast(null as integer) as sequence_step,
        created_at, expires_at, 0 as clicks, cast(null as timestamp) as last_clicked_at
    from ({IDENTITY_SQL})""")
def write_identity_map(spark, folder):
    path = new_folder(spark, "identity-map")
    writers.write_identity_map(identities(spark, folder), path)
    return spark.read.parquet(path)


@query("init_lead_profiles", f"""
    select short_id as visitor_id, campaign_id, email, company, 0 as total_sessions, 0 as intent_score,
        'cold' as engagement_level, false as synced_to_crm
    from ({IDENTITY_SQL})""")
def init_lead_profiles(spark, folder):
    path = new_folder(spark, "lead-profiles")
    writers.init_lead_profiles(identities(spark, folder), path)
    return spark.read.parquet(path).select(
        "visitor_id", "campaign_id", "email", "company", "total_sessions", "intent_score",
        "engagement_level", "synced_to_crm")


@query("write_profile_snapshot", f"""
    select tracking_id as key, '{{"tracking_id":"' || tracking_id || '","email":"' || email
        || '","total_sessions":' || cast(total_sessions as varchar) || ',"viewed_pricing":'
        || cast(viewed_pricing as varchar) || ',"engagement_level":"' || engagement_level || '"}}' as value_json,
        timestamp '2024-04-30 00:00:00' as expires_at
    from ({PROFILES_SQL})""")
def write_profile_snapshot(spark, folder):
    path = new_folder(spark, "snapshot")
    served = profile_table(spark, folder).select(
        "tracking_id", "email", "total_sessions", "viewed_pricing", "engagement_level")
    writers.write_profile_snapshot(writers.profile_snapshot(served, "tracking_id", AS_OF), path, 4)
    return spark.read.parquet(path).select("key", "value_json", "expires_at")


@query("identity_snapshot", f"""
    select short_id as key, cast(90 * 86400 as bigint) as ttl_seconds from ({IDENTITY_SQL})""")
def identity_snapshot(spark, folder):
    return writers.identity_snapshot(identities(spark, folder)).select("key", "ttl_seconds")


@query("write_hot_lead_alerts", HOT_SQL)
def write_hot_lead_alerts(spark, folder):
    path = new_folder(spark, "alerts")
    now = scored_profiles(spark, folder, "2024-01-04", "2024-01-04")
    before = scored_profiles(spark, folder, "2024-01-03", "2024-01-03")
    alerts = profiles.hot_lead_alerts(now, before).select("lead_id", "email", "intent_score")
    writers.write_hot_lead_alerts(alerts, path)
    return spark.read.schema(alerts.schema).json(path)


@query("event_table_by_day", """
    select event_id, type, path from te where cast(ts as date) >= date '2024-01-20'""")
def event_table_by_day(spark, folder):
    path = new_folder(spark, "enriched")
    out = enrich.enrich_events(events(spark, folder).drop("type", "category", "path"))
    (out.withColumn("event_date", F.to_date("ts")).select("event_id", "type", "path", "event_date")
     .repartition("event_date").write.partitionBy("event_date").parquet(path))
    return (enrich.retention_filter(spark.read.parquet(path), AS_OF, days=11)
            .select("event_id", "type", "path"))


# Events in three batches; the last week is sent again with the last one, under new ids.
@query("dedupe_across_batches", "select visitor_id, session_id, raw_type, ts, url, event_id, data from te")
def dedupe_across_batches(spark, folder):
    ev = raw_events(spark, folder)
    index = KeyIndex(spark, new_folder(spark, "event-keys"))
    at = [F.lit(t).cast("timestamp") for t in ("2024-01-11", "2024-01-21")]
    again = ev.filter(F.col("ts") >= at[1] - F.expr("interval 7 days")).withColumn("event_id", F.col("event_id") + 10**15)
    batches = [ev.filter(F.col("ts") < at[0]), ev.filter((F.col("ts") >= at[0]) & (F.col("ts") < at[1])),
               ev.filter(F.col("ts") >= at[1]).unionByName(again)]
    out = None
    for n, batch in enumerate(batches):
        fresh = index.add(batch, f"batch-{n}")
        out = fresh if out is None else out.unionByName(fresh)
    return out.select("visitor_id", "session_id", "raw_type", "ts", "url", "event_id", "data")


# Stored events without deleted leads and without days past retention, by files.
@query("delete_from_store", f"""
    select event_id, lead_id, web_visitor_id, cast(ts as date) as event_date from ({OWNED_SQL})
    where cast(ts as date) >= date '2024-01-31' - 20 and (lead_id is null or lead_id not in (
        select lead_id from leads where email_status = 'invalid'))""")
def delete_from_store(spark, folder):
    store = EventStore(spark, new_folder(spark, "event-store"), files_per_day=2)
    store.add(owned_events(spark, folder), "all")
    store.drop_days_before(AS_OF, days=20)
    store.delete_leads(samples.leads(spark, folder).filter("email_status = 'invalid'"), "asked")
    return store.read().select("event_id", "lead_id", "web_visitor_id", "event_date")


# The lead table page by page, put together again; between two pages every lead changes.
@query("leads_by_pages", "select lead_id, tracking_id, updated_at, email_status from leads")
def leads_by_pages(spark, folder):
    leads = samples.leads(spark, folder).select("lead_id", "tracking_id", "updated_at", "email_status")
    pages = PagedSnapshot(spark, new_folder(spark, "lead-pages"))
    cursor, out = pages.write(leads), None
    limit = leads.count() // 4 + 1
    while cursor is not None:
        page = pages.page(cursor, limit)
        if cursor.last is None:
            pages.write(leads.withColumn("updated_at", F.current_timestamp()))
        cursor = pages.after(cursor, page)
        out = page if out is None else out.unionByName(page)
    return out
