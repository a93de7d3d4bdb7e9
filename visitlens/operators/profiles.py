"""Lead profiles: 90-day behaviour, campaigns, the served row, intent score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from visitlens.functions import emails, events as ev, scores
from visitlens.functions.scalars import email_domain, filled, payload_number
from visitlens.operators import enrich
from visitlens.operators.periods import before, in_period

CAMPAIGNS_SERVED = 5

#: Lead attributes served as they are, empty text as absent.
SERVED = ["phone", "linkedin_url", "company_website", "company_description", "company_headcount",
          "company_linkedin", "job_title", "job_seniority", "job_department"]


def served(leads: DataFrame) -> list[Column]:
    """The attributes of :data:`SERVED`; those the table lacks are null."""
    return [(filled(F.col(c)) if c in leads.columns else F.lit(None).cast("string")).alias(c) for c in SERVED]


def visitor_behavior(events: DataFrame, as_of, days: int = 90, key: str = "visitor_id") -> DataFrame:
    """Per visitor over the last ``days``: sessions, page views, visits, flags.

    Page views are distinct times, so a view that was sent twice counts once.
    Spark groups by visitor and the distinct value first, so even a hot
    visitor's rows are spread over its sessions and times.
    """
    rows = in_period(events, before(as_of, days=days), as_of).filter(F.col(key).isNotNull())
    flags = ev.page_flags(F.col("type"), F.col("url"))
    slim = rows.select(key, "session_id", "ts", (F.col("type") == "page_view").alias("_view"),
                       *[flags[n].alias(n) for n in ("viewed_pricing", "requested_demo", "submitted_form")])
    marks = [F.bool_or(n).alias(n) for n in ("viewed_pricing", "requested_demo", "submitted_form")]
    return slim.groupBy(key).agg(
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct(F.when(F.col("_view"), F.col("ts"))).alias("total_pageviews"),
        F.max("ts").alias("last_visit"), F.min("ts").alias("first_visit"), *marks)


def campaign_summary(members: DataFrame) -> DataFrame:
    """Per tracking id: memberships in all, and the five latest.

    The ranking is cut to five before and after the shuffle, so a lead in very
    many campaigns sends five rows per task.
    """
    members = members.filter(F.col("tracking_id").isNotNull())
    newest = W.partitionBy("tracking_id").orderBy(F.desc("added_at"), F.desc("member_id"))
    latest = (members.withColumn("_r", F.row_number().over(newest))
              .filter(F.col("_r") <= CAMPAIGNS_SERVED)
              .groupBy("tracking_id")
              .agg(F.sort_array(F.collect_list(F.struct(
                  "_r", "campaign_id", "campaign_name", "status"))).alias("_c"))
              .select("tracking_id", F.transform("_c", lambda c: F.struct(
                  c["campaign_id"].alias("campaign_id"), c["campaign_name"].alias("campaign_name"),
                  c["status"].alias("status"))).alias("campaigns")))
    counts = members.groupBy("tracking_id").agg(F.count(F.lit(1)).alias("total_campaigns"))
    return counts.join(latest, "tracking_id")


def lead_profile_build(leads: DataFrame, behavior: DataFrame, campaigns: DataFrame) -> DataFrame:
    """The served row of every lead with a tracking id.

    Behaviour and campaigns are unique per id, so both joins keep one row per
    lead and no key is hot.
    """
    zero, no = F.lit(0), F.lit(False)
    seen = behavior.withColumnRenamed("visitor_id", "tracking_id").withColumn("_seen", F.lit(True))
    out = (enrich.name_fallback(leads.filter(filled(F.col("tracking_id")).isNotNull()))
           .join(seen, "tracking_id", "left").join(campaigns, "tracking_id", "left"))
    contact = emails.contact_email(F.col("work_email"), F.col("personal_email"))
    visited = F.coalesce("_seen", no)
    sessions = F.coalesce("total_sessions", zero)
    pricing = F.coalesce("viewed_pricing", no)
    return out.select(
        "tracking_id", "lead_id", "first_name", "last_name", "person_name", contact.alias("email"),
        F.coalesce(filled(F.col("company_website")), filled(email_domain(contact))).alias("domain"),
        "company_name", "company_industry", "company_revenue", *served(out),
        sessions.alias("total_sessions"), F.coalesce("total_pageviews", zero).alias("total_pageviews"),
        "last_visit", "first_visit", pricing.alias("viewed_pricing"),
        F.coalesce("requested_demo", no).alias("requested_demo"),
        F.coalesce("submitted_form", no).alias("submitted_form"),
        visited.alias("has_visited"), (~visited).alias("is_first_visit"),
        F.coalesce("total_campaigns", zero).alias("total_campaigns"),
        (F.coalesce("total_campaigns", zero) > 0).alias("is_in_campaign"),
        F.to_json("campaigns").alias("campaigns"),
        scores.engagement_rule(sessions, pricing, visited).alias("engagement_level"))


def activity_state(events: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Behaviour counters per visitor and session; mergeable by :func:`merge_activity_states`."""
    flags = ev.page_flags(F.col("type"), F.col("url"))
    view = F.col("type") == "page_view"
    data = F.col("data")
    slim = events.filter(F.col(key).isNotNull()).select(
        key, "session_id", "ts", "type", view.alias("_view"),
        (view & flags["viewed_pricing"]).alias("_pricing"),
        (view & flags["viewed_case_study"]).alias("_case"),
        (view & flags["viewed_product"]).alias("_product"),
        F.when(F.col("type") == "scroll_depth", payload_number(data, "depth")).alias("_depth"),
        F.when(F.col("type") == "page_exit", payload_number(data, "activeTime")).alias("_active"))
    return slim.groupBy(key, "session_id").agg(
        F.count_if("_view").alias("pageviews"), F.max("ts").alias("last_visit"),
        F.coalesce(F.sum("_active"), F.lit(0.0)).alias("active"),
        F.max("_depth").alias("depth"),
        F.count_if("_pricing").alias("pricing"), F.count_if("_case").alias("cases"),
        F.count_if("_product").alias("products"),
        F.count_if(F.col("type") == "form_submit").alias("forms"),
        F.count_if(F.col("type") == "video_complete").alias("videos"))


def merge_activity_states(states: DataFrame, key: str = "visitor_id") -> DataFrame:
    """One row per visitor and session out of the states of any batches."""
    sums = ["pageviews", "active", "pricing", "cases", "products", "forms", "videos"]
    return states.groupBy(key, "session_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("last_visit").alias("last_visit"), F.max("depth").alias("depth")
    ).select(*states.columns)


def activity_of(states: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Counters per visitor from states that are one row per session; scroll marks count once per session."""
    marks = sum((F.when(F.col("depth") >= m, 1).otherwise(0) for m in (25, 50, 75, 90, 100)), F.lit(0))
    return (states.withColumn("_marks", marks).groupBy(key).agg(
        F.count("session_id").alias("total_sessions"),
        F.sum("pageviews").alias("total_pageviews"),
        F.sum("active").cast("long").alias("total_active_time"),
        F.sum("_marks").alias("scroll_milestones"),
        F.max("last_visit").alias("last_visit_at"),
        F.sum("pricing").alias("pricing_page_visits"), F.sum("cases").alias("case_study_views"),
        F.sum("products").alias("product_page_views"), F.sum("forms").alias("form_submissions"),
        F.sum("videos").alias("video_completions")))


def lead_activity(events: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Behaviour counters per lead or visitor, over all events given.

    Sessions are summed up first; both steps combine rows before they shuffle.
    """
    return activity_of(activity_state(events, key), key)


def intent_score(activity: DataFrame, as_of) -> DataFrame:
    """Add ``intent_score`` and ``engagement_level`` to lead activity."""
    score = scores.intent_score(
        F.col("last_visit_at"), F.col("total_sessions"), F.col("total_pageviews"),
        F.col("total_active_time"), F.col("scroll_milestones"), F.col("pricing_page_visits"),
        F.col("case_study_views"), F.col("product_page_views"), F.col("form_submissions"),
        F.col("video_completions"), as_of)
    return (activity.withColumn("intent_score", score)
            .withColumn("engagement_level", scores.level_of(F.col("intent_score"))))


def lead_profiles(leads: DataFrame, activity: DataFrame, as_of) -> DataFrame:
    """Every lead with a tracking id, its activity and its score."""
    counters = [c for c in activity.columns if c not in ("visitor_id", "last_visit_at")]
    base = (leads.filter(filled(F.col("tracking_id")).isNotNull())
            .select("lead_id", "tracking_id",
                    emails.contact_email(F.col("work_email"), F.col("personal_email")).alias("email"),
                    "company_name")
            .join(activity.withColumnRenamed("visitor_id", "tracking_id"), "tracking_id", "left"))
    zeroed = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    return intent_score(zeroed, as_of)


def hot_lead_alerts(now: DataFrame, earlier: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads hot or burning now that were not at the previous run."""
    was = (earlier.filter(F.col("intent_score") >= scores.HOT_SCORE).select(key))
    return now.filter(F.col("intent_score") >= scores.HOT_SCORE).join(was, key, "left_anti")
