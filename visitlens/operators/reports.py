"""Reports: company, return visits, depth, levels, and the top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import scores
from visitlens.functions.scalars import payload_number
from visitlens.operators.periods import before, in_period
from visitlens.operators.skew import lookup


def company_activity(events: DataFrame) -> DataFrame:
    """Per company identifier: visitors, sessions, events, first and last seen."""
    return (events.filter(F.col("company_identifier").isNotNull())
            .groupBy("company_identifier")
            .agg(F.count_distinct("visitor_id").alias("visitors"),
                 F.count_distinct("session_id").alias("sessions"),
                 F.count(F.lit(1)).alias("events"),
                 F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
            .withColumn("has_multiple_visitors", F.col("visitors") > 1))


def visitor_return_patterns(events: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Visit days per visitor, their span, and the mean gap between them."""
    out = (events.filter(F.col(key).isNotNull())
           .groupBy(key)
           .agg(F.count_distinct(F.to_date("ts")).alias("total_visit_days"),
                F.min("ts").alias("first_visit"), F.max("ts").alias("last_visit")))
    span = F.datediff(F.to_date("last_visit"), F.to_date("first_visit"))
    gaps = F.nullif(F.col("total_visit_days") - 1, F.lit(0))
    return (out.withColumn("span_days", span)
            .withColumn("mean_gap_days", F.round(F.col("span_days") / gaps, 4)))


def content_depth(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: pages, mean seconds per page, reading ratio, good exits.

    The ratio is all reading time over all time on pages, so it does not depend
    on the order in which rows are added up.
    """
    data = F.col("data")
    exit_ = F.col("type") == "page_exit"
    on_page, reading, scanning = [payload_number(data, n)
                                  for n in ("totalTime", "readingTime", "scanningTime")]
    slim = events.filter(F.col(key).isNotNull() & F.col("type").isin("page_view", "page_exit")).select(
        key, exit_.alias("_exit"), F.when(exit_, on_page).alias("_total"),
        F.when(exit_, reading).alias("_reading"),
        (exit_ & F.coalesce(reading > scanning, F.lit(False))).alias("_high"))
    out = slim.groupBy(key).agg(
        F.count_if(~F.col("_exit")).alias("pageviews"), F.count_if("_exit").alias("exits"),
        F.round(F.avg("_total"), 3).alias("mean_seconds_per_page"),
        F.round(F.sum("_reading") / F.nullif(F.sum("_total"), F.lit(0.0)), 4).alias("reading_ratio"),
        F.count_if("_high").alias("_n"))
    share = F.col("_n") / F.nullif(F.col("exits"), F.lit(0))
    return out.withColumn("high_quality_share", F.round(share, 4)).drop("_n")


def high_intent_leads(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.col("intent_score") >= scores.HOT_SCORE)


def intent_distribution(profiles: DataFrame) -> DataFrame:
    """Leads per level and ten-point score bucket."""
    bucket = F.least(F.floor(F.col("intent_score") / 10) * 10, F.lit(90)).cast("int")
    return (profiles.groupBy("engagement_level", bucket.alias("score_from"))
            .agg(F.count(F.lit(1)).alias("leads")))


def campaign_performance(members: DataFrame, clicks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per campaign: recipients, clicks, high-intent recipients, conversion rate.

    ``clicks`` is ``tracking_id, clicks``; ``profiles`` has ``tracking_id,
    intent_score``. Members are reduced to one row per campaign and recipient
    first; clicks and score are unique per recipient, so one salted lookup
    serves a recipient who is in very many campaigns.
    """
    recipients = (members.filter(F.col("tracking_id").isNotNull())
                  .select("campaign_id", "campaign_name", "tracking_id").distinct())
    high = (high_intent_leads(profiles).select("tracking_id").distinct()
            .withColumn("_high", F.lit(1)))
    per_recipient = lookup(recipients, clicks.join(high, "tracking_id", "full"), "tracking_id",
                           "campaign_id")
    out = per_recipient.groupBy("campaign_id", "campaign_name").agg(
        F.count(F.lit(1)).alias("total_recipients"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("_high"), F.lit(0)).alias("high_intent_leads"))
    rate = F.col("high_intent_leads") / F.nullif(F.col("total_recipients"), F.lit(0)) * 100
    return out.withColumn("conversion_rate", F.round(rate, 2))


def recent_events(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Events of the last hours, newest first."""
    return (in_period(events, before(as_of, hours=hours))
            .orderBy(F.desc("ts"), F.desc("event_id"))
            .select("event_id", "ts", "type", "visitor_id", "url", "country"))


def recent_sessions(sessions: DataFrame, n: int, *tie: str) -> DataFrame:
    return sessions.orderBy(F.desc("start_time"), *tie).limit(n)


def top_hot_leads(profiles: DataFrame, n: int = 10) -> DataFrame:
    return (high_intent_leads(profiles).orderBy(F.desc("intent_score"), "lead_id").limit(n)
            .select("lead_id", "email", "company_name", "intent_score", "last_visit_at",
                    "pricing_page_visits"))


def unverified_emails(leads: DataFrame, email: Column, n: int = 1000) -> DataFrame:
    """Work list for address verification, in a fixed order."""
    return (leads.filter(F.col("email_status") == "unverified")
            .orderBy("lead_id").limit(n).select("lead_id", email.alias("email"), "tracking_id"))


def leads_page(leads: DataFrame, limit: int, offset: int) -> DataFrame:
    return leads.orderBy(F.desc("updated_at"), "lead_id").offset(offset).limit(limit)


def visitor_history(events: DataFrame, visitor_id: str, n: int = 10) -> DataFrame:
    return (events.filter(F.col("visitor_id") == visitor_id)
            .orderBy(F.desc("ts"), F.desc("event_id")).limit(n))


def leads_added_recently(leads: DataFrame, as_of, hours: int = 24, n: int = 10) -> DataFrame:
    return (leads.filter((F.col("created_at") >= before(as_of, hours=hours)) & F.col("tracking_id").isNotNull())
            .orderBy(F.desc("created_at"), "lead_id").limit(n))
