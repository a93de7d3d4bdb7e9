"""New snapshots from an old one and what came in.

Each job returns the whole new snapshot (or the touched part, where it says so)
and leaves writing to the caller, who writes a new folder and then switches to
it. Running a job twice gives what running it once gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.functions import emails
from visitlens.functions.scalars import filled, payload
from visitlens.operators import identity
from visitlens.operators.skew import HOT_ROWS, lookup


def upsert_web_visitors(visitors: DataFrame, events: DataFrame) -> DataFrame:
    """Visitors after new events: last seen moves on, new ones are added."""
    place = F.struct("ts", "event_id")
    device = payload(F.col("data"), "deviceFingerprint")
    browser = filled(payload(F.col("data"), "browserId"))
    seen = (events.filter(filled(F.col("visitor_id")).isNotNull())
            .select("visitor_id", "ts", "event_id", device.alias("_d"), browser.alias("_b"))
            .groupBy("visitor_id")
            .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"),
                 F.min_by("_d", F.when(F.col("_d").isNotNull(), place)).alias("_d"),
                 F.min_by("_b", F.when(F.col("_b").isNotNull(), place)).alias("_b")))
    out = visitors.withColumn("_old", F.lit(True)).join(seen, "visitor_id", "full")
    old = F.col("_old").isNotNull()
    return out.withColumns({
        "device_fingerprint": F.when(old, F.col("device_fingerprint")).otherwise(F.col("_d")),
        "browser_id": F.when(old, F.col("browser_id")).otherwise(F.col("_b")),
        "first_seen_at": F.least("first_seen_at", "_first"),
        "last_seen_at": F.greatest("last_seen_at", "_last"),
        "is_identified": F.coalesce("is_identified", F.lit(False)),
    }).select(*visitors.columns)


def upsert_leads(leads: DataFrame, signals: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Leads plus one for every signal that matches none of them."""
    open_ = identity.resolve_lead(signals, leads, hot_rows=hot_rows).filter(
        F.col("lead_id").isNull() & (F.col("tracking_id").isNotNull() | filled(F.col("email")).isNotNull()))
    return leads.unionByName(identity.new_leads(open_), allowMissingColumns=True)


def update_lead_identity(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch leads; an empty value never overwrites.

    ``patches`` is unique on ``lead_id``, with ``email`` and any of the lead
    attributes. The address goes to the work or the personal column.
    """
    fields = [f for f in schemas.LEAD_PATCH_FIELDS if f in patches.columns and f in leads.columns]
    personal = emails.is_personal(F.col("email"))
    patch = patches.select(
        "lead_id", F.when(~personal, filled(F.col("email"))).alias("_work_email"),
        F.when(personal, filled(F.col("email"))).alias("_personal_email"),
        *[filled(F.col(f).cast("string")).alias(f"_{f}") for f in fields])
    out = leads.join(patch, "lead_id", "left")
    for f in fields + ["work_email", "personal_email"]:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.select(*leads.columns)


def identify_visitors(visitors: DataFrame, identified: DataFrame) -> DataFrame:
    """Mark visitors as identified; the earliest identification wins.

    ``identified`` is ``visitor_id, lead_id, ts, method``, any number of rows
    per visitor. A visitor already identified earlier stays as it is.
    """
    first = (identified.groupBy("visitor_id")
             .agg(F.min(F.struct("ts", "lead_id", "method")).alias("_i")))
    base = visitors
    if "identification_method" not in base.columns:
        base = base.withColumn("identification_method", F.lit(None).cast("string"))
    out = base.join(first, "visitor_id", "left")
    take = F.col("_i").isNotNull() & (
        ~F.col("is_identified") | F.col("lead_id").isNull()
        | F.coalesce(F.col("_i.ts") < F.col("identified_at"), F.lit(False)))
    return out.withColumns({
        "lead_id": F.when(take, F.col("_i.lead_id")).otherwise(F.col("lead_id")),
        "identified_at": F.when(take, F.col("_i.ts")).otherwise(F.col("identified_at")),
        "identification_method": F.when(take, F.col("_i.method")).otherwise(
            F.col("identification_method")),
        "is_identified": F.col("is_identified") | F.coalesce(take, F.lit(False)),
    }).drop("_i")


def attach_email_hashes(visitors: DataFrame, signals: DataFrame) -> DataFrame:
    """Store address hashes and domain on anonymous visitors.

    The first signal with a hash or an address wins; hashes not sent along are
    computed, and the address itself is not kept.
    """
    e = F.col("email")
    sent = signals.filter(filled(e).isNotNull()).select(
        "visitor_id", "ts", F.coalesce(filled(F.col("sha256")), emails.sha256_of(e)).alias("sha256"),
        F.coalesce(filled(F.col("sha1")), emails.sha1_of(e)).alias("sha1"),
        F.coalesce(filled(F.col("md5")), emails.md5_of(e)).alias("md5"),
        F.get(F.split(e, "@"), 1).alias("email_domain"))
    first = (sent.groupBy("visitor_id")
             .agg(F.min(F.struct("ts", "sha256", "sha1", "md5", "email_domain")).alias("_h")))
    base = visitors
    for c in ("sha256", "sha1", "md5", "email_domain"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    out = base.join(first, "visitor_id", "left")
    fresh = ~F.coalesce("is_identified", F.lit(False)) & F.col("sha256").isNull()
    return out.withColumns({
        c: F.when(fresh, F.col(f"_h.{c}")).otherwise(F.col(c))
        for c in ("sha256", "sha1", "md5", "email_domain")}).drop("_h")


def assign_tracking_ids(leads: DataFrame, campaign_id: str = "default") -> DataFrame:
    """Give leads without a tracking id their deterministic one."""
    made = emails.tracking_id_for(
        emails.contact_email(F.col("work_email"), F.col("personal_email")), F.lit(campaign_id))
    return leads.withColumn("tracking_id", F.coalesce(filled(F.col("tracking_id")), made))


def update_email_status(leads: DataFrame, results: DataFrame, email: str = "email") -> DataFrame:
    """Set each lead's status from its own verification result.

    ``results`` has ``email, email_status``. Several results for one address
    are reduced to the lowest status name; without a result nothing changes.
    """
    one = (results.groupBy(emails.normal_email(F.col("email")).alias("_e"))
           .agg(F.min("email_status").alias("_status")))
    rows = leads.withColumn("_e", emails.normal_email(F.col(email)))
    out = lookup(rows, one, "_e", "lead_id")
    return (out.withColumn("email_status", F.coalesce("_status", "email_status"))
            .select(*leads.columns))


def merge_touched(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key was not touched, plus the recomputed ones."""
    return old.join(fresh, keys, "left_anti").unionByName(fresh.select(*old.columns))


def delete_lead(table: DataFrame, deleted: DataFrame, key: str = "lead_id",
                spread_by: str = "event_id") -> DataFrame:
    """A table without the rows of deleted leads; use on leads and events alike.

    Rows without a lead are kept. They, and those of a hot lead, are spread by
    another column of the table.
    """
    gone = deleted.select(key).filter(F.col(key).isNotNull()).distinct()
    return lookup(table, gone, key, spread_by, how="left_anti")
