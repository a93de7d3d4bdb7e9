"""Named queries: streaming jobs run to the end over the sample tables.

Input is written in event-time order, about a fifth of the time span at a time,
and one such period is read per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.plans.behavior_queries import COMPRESS
from visitlens.plans.catalog import events, query, raw_events
from visitlens.plans.profile_queries import scored_profiles, scored_sql
from visitlens.session import new_folder

from visitlens.streaming import jobs

STEP_SECONDS = 6 * 24 * 3600
# A file is read and written by one task.
ROWS_PER_FILE = 100_000
# Rows dealt round by round leave no file empty if there are many for each.
LEAST_PER_FILE = 1_000


def as_stream(spark: SparkSession, df: DataFrame, order: str = "ts",
              step: int = STEP_SECONDS) -> DataFrame:
    """A table as a stream, one period of time per micro-batch.

    The file source takes files by modification time, so periods are written
    one after the other, each into the same number of files.
    """
    path = new_folder(spark, "feed")
    table = new_folder(spark, "feed-table")
    period = F.floor(F.unix_seconds(order) / F.lit(step)).cast("long")
    df.withColumn("_period", period).write.partitionBy("_period").parquet(table)
    stored = spark.read.parquet(table)
    sizes = stored.groupBy("_period").count().agg(
        F.min("_period"), F.max("_period"), F.min("count"), F.max("count")).first()
    files = max(1, min(sizes[2] // LEAST_PER_FILE, -(-sizes[3] // ROWS_PER_FILE)))
    for p in range(sizes[0], sizes[1] + 1):
        (stored.filter(F.col("_period") == p).drop("_period").repartition(files)
         .write.mode("append").parquet(path))
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path))


def finished(query_) -> None:
    query_.awaitTermination()


@query("stream_ingest", "select event_id, type, path, cast(ts as date) as event_date from te")
def stream_ingest(spark, folder):
    out = new_folder(spark, "stream-ingest")
    finished(jobs.stream_ingest(as_stream(spark, raw_events(spark, folder)), out))
    return spark.read.parquet(f"{out}/out").select("event_id", "type", "path", "event_date")


# Every fourth user's batches are sent twice, within minutes.
@query("stream_dedupe", "select visitor_id, session_id, raw_type, ts, url from te")
def stream_dedupe(spark, folder):
    ev = raw_events(spark, folder)
    user = F.regexp_extract("session_id", "s([0-9]+)-", 1).cast("long")
    again = ev.filter(user % 4 == 1).withColumn("event_id", F.col("event_id") + 10**15)
    out = new_folder(spark, "stream-dedupe")
    # One file holds six days; the watermark covers them.
    finished(jobs.stream_dedupe(as_stream(spark, ev.unionByName(again)), out, delay="7 days"))
    return spark.read.parquet(f"{out}/out").select("visitor_id", "session_id", "raw_type", "ts", "url")


# A session is out once its end plus the gap is behind the watermark.
@query("stream_sessions", """
    with s as (select visitor_id, n, min(ts) as start_time, max(ts) as end_time, count(*) as events,
            count(*) filter (type = 'page_view') as pageviews, count(*) filter (type = 'click') as clicks
        from (select *, sum(case when gap <= interval 30 minute then 0 else 1 end)
                over (partition by visitor_id order by ts, event_id rows unbounded preceding) as n
            from (select *, ts - lag(ts) over (partition by visitor_id order by ts, event_id) as gap
                from te where visitor_id is not null)) group by visitor_id, n)
    select visitor_id, start_time, end_time, events, pageviews, clicks from s
    where end_time + interval 30 minute <= (select max(ts) from te where visitor_id is not null) - interval 7 day""")
def stream_sessions(spark, folder):
    out = new_folder(spark, "stream-sessions")
    finished(jobs.stream_sessions(as_stream(spark, events(spark, folder)), out, delay="7 days"))
    return spark.read.parquet(f"{out}/out")


@query("stream_visitor_totals", """
    select visitor_id, count(*) filter (type = 'page_view') as total_pageviews,
        count(*) filter (type = 'click') as total_clicks, count(distinct session_id) as total_sessions,
        max(ts) as last_seen_at
    from te where visitor_id is not null group by visitor_id""")
def stream_visitor_totals(spark, folder):
    out = new_folder(spark, "stream-totals")
    finished(jobs.stream_visitor_totals(as_stream(spark, events(spark, folder)), out))
    return jobs.visitor_totals_of(jobs.visitor_sessions_log(spark, out).read())


@query("stream_recent_leads", """
    select window_start, lead_id, count(*) as events from (
        select 'L' || substr(visitor_id, 2) as lead_id,
            unnest([time_bucket(interval 5 minute, ts), time_bucket(interval 5 minute, ts) - interval 5 minute]) as window_start
        from te where visitor_id is not null)
    where window_start + interval 10 minute <= (select max(ts) from te where visitor_id is not null) - interval 7 day
    group by 1, 2""")
def stream_recent_leads(spark, folder):
    owned = events(spark, folder).withColumn("lead_id", F.concat(
        F.lit("L"), F.substring("visitor_id", 2, 20)))
    out = new_folder(spark, "stream-leads")
    finished(jobs.stream_recent_leads(as_stream(spark, owned), out, delay="7 days"))
    return spark.read.parquet(f"{out}/out")


RAGE_DELAY_SECONDS = 1


@query("stream_rage_clicks", f"""
    with recursive c as (
        select user_id, event_id, make_timestamp(cast(floor(epoch_us(ts) / {COMPRESS}) as bigint)) as ts,
            row_number() over (partition by user_id order by ts, event_id) as n
        from te where type = 'click'),
    mark as (select epoch_us(max(ts)) - {RAGE_DELAY_SECONDS * 1_000_000} as us from c),
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
    select 'u' || cast(user_id as varchar) as session_id, event_id, ts from walk, mark
    where hit and epoch_us(ts) <= mark.us""")
def stream_rage_clicks(spark, folder):
    ev = events(spark, folder).select(
        "event_id", "type", F.concat(F.lit("u"), F.regexp_extract("session_id", "s([0-9]+)-", 1)).alias("person"),
        F.timestamp_micros(F.floor(F.unix_micros("ts") / COMPRESS)).alias("ts"))
    out = new_folder(spark, "stream-rage")
    finished(jobs.stream_rage_clicks(as_stream(spark, ev, step=2), out, "person", RAGE_DELAY_SECONDS))
    return (spark.read.schema(jobs.RAGE_LOG).parquet(f"{out}/out").filter("kind = 'hit'")
            .select("session_id", "event_id", "ts"))


@query("stream_identity", """
    select visitor_id, ts, event_id, tracking_id, sha256(email) as email_sha256 from te
    where visitor_id is not null and (tracking_id is not null or email is not null)
    qualify row_number() over (partition by visitor_id order by ts, event_id) = 1""")
def stream_identity(spark, folder):
    out = new_folder(spark, "stream-identity")
    finished(jobs.stream_identity(as_stream(spark, events(spark, folder)), out))
    return spark.read.parquet(f"{out}/out")


HOT_RUNS = ["2024-01-03", "2024-01-04", "2024-01-12"]


@query("stream_hot_leads", f"""
    select lead_id, as_of, intent_score from (
        select *, lag(intent_score, 1, 0) over (partition by lead_id order by as_of) as before from ({' union all '.join(
        f"select lead_id, timestamp '{d}' as as_of, intent_score from ({scored_sql(d, d)})" for d in HOT_RUNS)}))
    where intent_score >= 60 and before < 60""")
def stream_hot_leads(spark, folder):
    runs = None
    for day in HOT_RUNS:
        run = scored_profiles(spark, folder, day, day).select(
            "lead_id", F.lit(day).cast("timestamp").alias("as_of"), "intent_score")
        runs = run if runs is None else runs.unionByName(run)
    out = new_folder(spark, "stream-hot")
    finished(jobs.stream_hot_leads(as_stream(spark, runs, "as_of", 24 * 3600), out))
    return jobs.lead_scores_log(spark, out).outcomes(jobs.HOT).drop("batch")


def sent_events(spark, folder):
    ev = raw_events(spark, folder)
    sent = ev.groupBy("batch_id").agg(F.timestamp_millis(
        F.max(F.unix_millis("ts")) + 1000).alias("sent_at"))
    return ev.join(sent, "batch_id")


LATE_DELAY_DAYS = 20


# Events in the order they were sent; a batch goes out when its last event is a second old.
@query("stream_lateness", f"""
    with s as (select country as source, ts, date_trunc('milliseconds', max(ts) over (partition by batch_id)) + interval 1 second as sent_at
        from te),
    p as (select *, cast(floor(epoch_us(sent_at) / 1000000 / {STEP_SECONDS}) as bigint) as period,
        epoch_ms(sent_at) - epoch_ms(ts) as lag from s),
    newest as (select period, max(max(ts)) over (order by period rows between unbounded preceding and 1 preceding) as seen
        from p group by period)
    select source, count(*) as rows, count(*) filter (not gone and lag <= 86400000) as on_time,
        count(*) filter (not gone and lag > 86400000) as late, count(*) filter (gone) as dropped
    from (select *, coalesce(ts < seen - interval {LATE_DELAY_DAYS} day, false) as gone from p join newest using (period))
    group by source""")
def stream_lateness(spark, folder):
    out = new_folder(spark, "stream-lateness")
    sent = sent_events(spark, folder)
    finished(jobs.stream_lateness(as_stream(spark, sent, "sent_at"), out, F.col("country"), 24 * 3600,
                                  LATE_DELAY_DAYS * 24 * 3600))
    return jobs.lateness_log(spark, out).read().select("source", "rows", "on_time", "late", "dropped")


@query("late_events", """
    select event_id, late_seconds from (
        select event_id, cast(floor((epoch_us(date_trunc('milliseconds', max(ts) over (partition by batch_id)))
                + 1000000 - epoch_us(ts)) / 1000000.0) as bigint) as late_seconds,
            epoch_us(date_trunc('milliseconds', max(ts) over (partition by batch_id))) + 1000000 - epoch_us(ts) as us
        from te) where us > 3600000000""")
def late_events(spark, folder):
    out = new_folder(spark, "stream-late")
    finished(jobs.late_events(as_stream(spark, sent_events(spark, folder)), out))
    return spark.read.parquet(f"{out}/out").select("event_id", "late_seconds")
