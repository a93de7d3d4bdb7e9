"""Campaign identities and e-mail clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import emails
from visitlens.functions.scalars import as_ts, filled, payload


def create_identities(leads: DataFrame, campaign_id: str, campaign_name: str, created_at,
                      days: int = 90) -> DataFrame:
    """One identity per lead of a campaign, valid for ``days``."""
    created: Column = as_ts(created_at)
    names = [(F.col(c) if c in leads.columns else F.lit(None).cast("string")).alias(c)
             for c in ("first_name", "last_name", "company")]
    return leads.filter(filled(F.col("email")).isNotNull()).select(
        emails.tracking_id_for(F.col("email"), F.lit(campaign_id)).alias("short_id"),
        F.lit(None).cast("string").alias("visitor_id"), "email", *names,
        F.lit(campaign_id).alias("campaign_id"), F.lit(campaign_name).alias("campaign_name"),
        F.lit(None).cast("int").alias("sequence_step"), created.alias("created_at"),
        F.timestamp_micros(F.unix_micros(created) + days * 86_400_000_000).alias("expires_at"))


def tracking_id_collisions(identities: DataFrame, person: Column | None = None,
                           partitions: int | None = None) -> DataFrame:
    """Ids shared by different addresses; eight hex digits make some likely.

    ``person`` tells addresses apart if not the address itself does, such as a number per address.
    With ``partitions`` a row is shuffled once, by its id alone: for addresses that come once per campaign,
    as then no id has many rows.
    """
    person = emails.normal_email(F.col("email")) if person is None else person
    rows = identities.select("short_id", person.alias("_person"))
    if partitions:
        rows = rows.repartition(partitions, "short_id")
    return (rows.groupBy("short_id").agg(F.count_distinct("_person").alias("emails"))
            .filter("emails > 1"))


def email_clicks(events: DataFrame) -> DataFrame:
    """Click counts and times per tracking id."""
    tag = F.coalesce(filled(payload(F.col("data"), "tracking_id")), F.col("visitor_id"))
    return (events.filter(F.col("type") == "email_click")
            .select(tag.alias("tracking_id"), "ts").filter("tracking_id is not null")
            .groupBy("tracking_id")
            .agg(F.count(F.lit(1)).alias("clicks"), F.min("ts").alias("first_click_at"),
                 F.max("ts").alias("last_clicked_at")))


def email_click_attribution(identities: DataFrame, events: DataFrame,
                            key: str = "short_id") -> DataFrame:
    """Identities with their clicks. Clicks are summed before they are joined."""
    counted = email_clicks(events).withColumnRenamed("tracking_id", key)
    old = [c for c in ("clicks", "last_clicked_at") if c in identities.columns]
    return (identities.drop(*old).join(counted, key, "left")
            .withColumn("clicks", F.coalesce("clicks", F.lit(0))))
