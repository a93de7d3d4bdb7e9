"""Sinks. Each takes a DataFrame and a folder every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import urls
from visitlens.functions.emails import normal_email
from visitlens.functions.scalars import as_ts, hash32
from visitlens.operators import enrich

SNAPSHOT_TTL_SECONDS = 90 * 24 * 60 * 60

# Columns of the campaign link file.
CAMPAIGN_FILE_COLUMNS = ["Email", "First Name", "Last Name", "Company", "Tracking URL", "Short ID"]


def write_events(events: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Append events that have exactly one owner, by day.

    Rows of a day are spread over ``files_per_day`` writers by event id, never
    by visitor, so a hot visitor does not fill one file. Without the argument
    each task writes the days it holds.
    """
    valid, _ = enrich.owner_check(events)
    out = valid.withColumn("event_date", F.to_date("ts"))
    if files_per_day:
        out = (out.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(files_per_day)))
               .repartition("event_date", "_part").drop("_part"))
    (out.sortWithinPartitions("event_date", "web_visitor_id", "lead_id", "ts")
     .write.partitionBy("event_date").mode("append").parquet(path))


def write_events_jdbc(events: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """The same append into a relational store, 1000 rows per round trip."""
    valid, _ = enrich.owner_check(events)
    valid.write.jdbc(url, table, mode="append", properties={"batchsize": "1000", **properties})


def campaign_file(identities: DataFrame, base_url: str, destination: str = "/") -> DataFrame:
    def text(c: str):
        return F.coalesce(F.col(c), F.lit(""))

    return identities.select(
        F.col("email").alias("Email"), text("first_name").alias("First Name"),
        text("last_name").alias("Last Name"), text("company").alias("Company"),
        urls.tracking_url(base_url, F.col("short_id"), destination).alias("Tracking URL"),
        F.col("short_id").alias("Short ID"))


def write_campaign_urls(identities: DataFrame, base_url: str, path: str,
                        destination: str = "/") -> None:
    """CSV of tracking links, every data cell quoted, quotes doubled."""
    campaign_file(identities, base_url, destination).write.csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="", mode="overwrite")


def identity_map(identities: DataFrame) -> DataFrame:
    """Identity rows as stored: a click counter at zero, and a hashed address."""
    return identities.select(
        "short_id", "visitor_id", "email", hash32(normal_email(F.col("email"))).alias("email_hash"),
        "first_name", "last_name", "company", "campaign_id", "campaign_name", "sequence_step",
        "created_at", "expires_at", F.lit(0).alias("clicks"),
        F.lit(None).cast("timestamp").alias("last_clicked_at"))


def write_identity_map(identities: DataFrame, path: str, mode: str = "append") -> None:
    identity_map(identities).write.mode(mode).parquet(path)


def initial_profiles(identities: DataFrame) -> DataFrame:
    """One zeroed, cold profile per identity; the short id is the visitor id."""
    # Counters of a profile, all zero at the start.
    counters = ["total_sessions", "total_pageviews", "total_active_time", "intent_score",
                "pricing_page_visits", "case_study_views", "product_page_views",
                "form_submissions", "video_completions"]
    return identities.select(
        F.col("short_id").alias("visitor_id"), "campaign_id", "campaign_name", "email",
        "first_name", "last_name", "company", *[F.lit(0).alias(c) for c in counters],
        F.lit("cold").alias("engagement_level"), F.lit(False).alias("synced_to_crm"))


def init_lead_profiles(identities: DataFrame, path: str, mode: str = "append") -> None:
    initial_profiles(identities).write.mode(mode).parquet(path)


def profile_snapshot(profiles: DataFrame, key: str, as_of,
                     ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Serving rows: key, profile as JSON, end of life."""
    rest = [c for c in profiles.columns if c != key]
    return profiles.select(
        F.col(key).alias("key"),
        F.to_json(F.struct(key, *rest)).alias("value_json"),
        F.timestamp_micros(F.unix_micros(as_ts(as_of)) + ttl_seconds * 1_000_000)
        .alias("expires_at"))


def identity_snapshot(identities: DataFrame) -> DataFrame:
    """Serving rows for identities; life in whole seconds from their dates."""
    life = F.floor((F.unix_millis("expires_at") - F.unix_millis("created_at")) / F.lit(1000))
    return identities.select(
        F.col("short_id").alias("key"),
        F.to_json(F.struct(*identities.columns)).alias("value_json"),
        life.cast("long").alias("ttl_seconds"))


def write_profile_snapshot(rows: DataFrame, path: str, buckets: int = 16) -> None:
    """Write serving rows clustered by a hash of the key, for point lookups."""
    (rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
     .repartition("bucket").sortWithinPartitions("bucket", "key")
     .write.partitionBy("bucket").mode("overwrite").parquet(path))


def write_hot_lead_alerts(alerts: DataFrame, path: str) -> None:
    """Newly hot leads as JSON lines for a downstream system."""
    alerts.write.mode("append").json(path)
