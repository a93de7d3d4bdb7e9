"""Who sent an event: batch signals, lead lookup, owners, de-anonymising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import emails
from visitlens.functions.scalars import (
    bound, email_domain, filled, first_filled, payload, payload_struct)
from visitlens.operators.periods import before, in_period
from visitlens.operators.profiles import SERVED, served
from visitlens.operators.skew import HOT_ROWS, lookup
from visitlens.session import enable_checkpoints

HASH_KINDS = ["sha256", "sha1", "md5"]

# Payload fields that say who sent an event.
SIGNAL_FIELDS = (
    "tracking_id string, deviceFingerprint string, browserId string, firstName string,"
    " lastName string, email string, emailHash string, sha256 string, sha1 string, md5 string,"
    " emails array<struct<email: string, sha256: string, hash: string, sha1: string, md5: string>>")


def batch_identity_signal(events: DataFrame) -> DataFrame:
    """What a batch says about its sender.

    Visitor, tracking id, device and browser come from the first event only.
    The address comes from the first event that has one, in clear or in a
    browser scan, with the hashes sent beside it.
    """
    p = payload_struct(F.col("data"), SIGNAL_FIELDS)
    scan = F.get(F.col("_p.emails"), 0)
    clear = F.col("_p.email")
    scanned = F.when(F.col("type") == "browser_emails_scanned", scan["email"])
    address = F.when(clear.contains("@"), F.struct(
        clear.alias("email"),
        first_filled(F.col("_p.emailHash"), F.col("_p.sha256")).alias("sha256"),
        F.col("_p.sha1").alias("sha1"), F.col("_p.md5").alias("md5"))
    ).when(scanned.contains("@"), F.struct(
        scanned.alias("email"), first_filled(scan["sha256"], scan["hash"]).alias("sha256"),
        scan["sha1"].alias("sha1"), scan["md5"].alias("md5")))
    slim = events.select("batch_id", "pos", "ts", "type", "visitor_id", p.alias("_p")).select(
        "batch_id", "pos", "ts", address.alias("_a"), F.struct(
            filled(F.col("visitor_id")).alias("visitor_id"),
            filled(F.col("_p.tracking_id")).alias("tracking_id"),
            F.col("_p.deviceFingerprint").alias("device_fingerprint"),
            filled(F.col("_p.browserId")).alias("browser_id"),
            F.col("_p.firstName").alias("first_name"),
            F.col("_p.lastName").alias("last_name")).alias("_s"))
    out = slim.groupBy("batch_id").agg(
        F.min_by("_s", "pos").alias("_s"), F.min("ts").alias("ts"),
        F.min_by("_a", F.when(F.col("_a").isNotNull(), F.col("pos"))).alias("_a"))
    # A batch without any visitor id gets one that a re-run finds again.
    return (out.select("batch_id", "ts", "_s.*", "_a.*")
            .withColumn("visitor_id", F.coalesce(
                "visitor_id", "browser_id", "device_fingerprint",
                F.concat(F.lit("visitor-"), F.col("batch_id")))))


def envelope_signals(envelopes: DataFrame) -> DataFrame:
    """:func:`batch_identity_signal` of batches that still are one row each, with the batch's session.

    ``envelopes`` has ``batch_id`` and ``events``, the array in sending order. Nothing is
    exploded or shuffled. A batch without events says nothing and is left out.
    """
    def address_of(e: Column) -> Column:
        p = F.from_json(e["data"], SIGNAL_FIELDS)
        return bound(p, lambda p: F.when(p["email"].contains("@"), F.struct(
            p["email"].alias("email"), first_filled(p["emailHash"], p["sha256"]).alias("sha256"),
            p["sha1"].alias("sha1"), p["md5"].alias("md5"))).when(
            (e["type"] == "browser_emails_scanned") & F.get(p["emails"], 0)["email"].contains("@"),
            bound(F.get(p["emails"], 0), lambda scan: F.struct(
                scan["email"].alias("email"), first_filled(scan["sha256"], scan["hash"]).alias("sha256"),
                scan["sha1"].alias("sha1"), scan["md5"].alias("md5")))))

    found = F.get(F.filter(F.transform("events", address_of), lambda a: a.isNotNull()), 0)
    rows = envelopes.filter(F.size("events") > 0).select(
        "batch_id", F.get("events", 0).alias("_f"), found.alias("_a"),
        F.timestamp_millis(F.array_min(F.transform("events", lambda e: e["timestamp"]))).alias("ts"))
    rows = rows.withColumn("_p", F.from_json("_f.data", SIGNAL_FIELDS)).select(
        "batch_id", "ts", filled(F.col("_f.visitorId")).alias("visitor_id"),
        filled(F.col("_p.tracking_id")).alias("tracking_id"),
        F.col("_p.deviceFingerprint").alias("device_fingerprint"),
        filled(F.col("_p.browserId")).alias("browser_id"), F.col("_p.firstName").alias("first_name"),
        F.col("_p.lastName").alias("last_name"), F.col("_f.sessionId").alias("batch_session_id"), "_a.*")
    return rows.withColumn("visitor_id", F.coalesce(
        "visitor_id", "browser_id", "device_fingerprint", F.concat(F.lit("visitor-"), F.col("batch_id"))))


def lead_emails(leads: DataFrame) -> DataFrame:
    """``email, lead_id`` over work and personal addresses, lowest id each."""
    return (leads.select("lead_id", F.explode(F.array("work_email", "personal_email")).alias("email"))
            .filter(filled(F.col("email")).isNotNull())
            .groupBy("email").agg(F.min("lead_id").alias("lead_id")))


def lead_tracking_ids(leads: DataFrame) -> DataFrame:
    return (leads.filter(filled(F.col("tracking_id")).isNotNull())
            .groupBy("tracking_id").agg(F.min("lead_id").alias("lead_id")))


def resolve_lead(signals: DataFrame, leads: DataFrame, row: str = "batch_id",
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``lead_id`` and ``resolved_by``: tracking id first, then address.

    Two equality joins; one join on "either matches" would be a nested loop.
    """
    by_tracking = lead_tracking_ids(leads).withColumnRenamed("lead_id", "_by_tracking")
    by_email = lead_emails(leads).withColumnRenamed("lead_id", "_by_email")
    out = lookup(signals, by_tracking, "tracking_id", row, hot_rows=hot_rows)
    out = lookup(out, by_email, "email", row, hot_rows=hot_rows)
    return (out.withColumn("lead_id", F.coalesce("_by_tracking", "_by_email"))
            .withColumn("resolved_by", F.when(F.col("_by_tracking").isNotNull(), "tracking_id")
                        .when(F.col("_by_email").isNotNull(), "email"))
            .drop("_by_tracking", "_by_email"))


def visitor_status(rows: DataFrame, visitors: DataFrame, row: str = "batch_id",
                   hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``is_identified`` and ``known_lead_id``; unknown visitors are not."""
    known = visitors.select("visitor_id", F.col("is_identified").alias("_known"),
                            F.col("lead_id").alias("known_lead_id"))
    out = lookup(rows, known, "visitor_id", row, hot_rows=hot_rows)
    return (out.withColumn("is_identified", F.coalesce("_known", F.lit(False)))
            .withColumn("known_lead_id", F.when(F.col("is_identified"), F.col("known_lead_id")))
            .drop("_known"))


def new_lead_id(key: Column) -> Column:
    """Id of a lead not yet stored; the same key always gives the same id."""
    return F.concat(F.lit("lead-"), F.substring(F.sha2(key, 256), 1, 32))


def new_leads(unresolved: DataFrame) -> DataFrame:
    """Leads to create for signals that match none.

    One lead per tracking id, with the first address sent along; one per
    further address that no such lead has.
    """
    place = F.struct("ts", "batch_id")
    address = filled(F.col("email"))
    tracked = (unresolved.filter(F.col("tracking_id").isNotNull())
               .groupBy("tracking_id")
               .agg(F.min_by("email", F.when(address.isNotNull(), place)).alias("work_email"),
                    F.min(F.struct("ts", "batch_id", "first_name", "last_name")).alias("_f")))
    taken = tracked.filter(F.col("work_email").isNotNull()).select(F.col("work_email").alias("email")).distinct()
    addressed = (unresolved.filter(F.col("tracking_id").isNull() & address.isNotNull())
                 .groupBy("email")
                 .agg(F.min(F.struct("ts", "batch_id", "first_name", "last_name")).alias("_f"))
                 .join(taken, "email", "left_anti")
                 .select(F.lit(None).cast("string").alias("tracking_id"),
                         F.col("email").alias("work_email"), "_f"))
    method = F.when(F.col("work_email").isNotNull(), "email_capture").otherwise("tracking_id")
    return tracked.unionByName(addressed).select(
        new_lead_id(F.coalesce("tracking_id", "work_email")).alias("lead_id"), "tracking_id",
        "work_email", F.col("_f.first_name").alias("first_name"),
        F.col("_f.last_name").alias("last_name"), F.col("_f.ts").alias("identified_at"),
        method.alias("identification_method"))


def batch_owners(signals: DataFrame, leads: DataFrame, visitors: DataFrame,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exactly one owner per batch: a lead or an anonymous visitor.

    A tracking id means the lead with it, else the lead with the address, else
    a new lead. Without a tracking id an address means the lead the visitor is
    known as, else the lead with the address, else a new lead. Otherwise the
    visitor stays anonymous. ``signals`` should be a written table: it is counted once, and where it
    has fewer rows than a hot key the joins look for none.
    """
    if signals.count() < hot_rows:
        hot_rows = None
    known = visitor_status(resolve_lead(signals, leads, hot_rows=hot_rows), visitors,
                           hot_rows=hot_rows)
    tracked = F.col("tracking_id").isNotNull()
    addressed = filled(F.col("email")).isNotNull()
    found = (F.when(tracked, F.col("lead_id"))
             .when(addressed, F.coalesce("known_lead_id", "lead_id")))
    open_ = known.withColumn("_lead", found)
    created = new_leads(open_.filter(F.col("_lead").isNull() & (tracked | addressed)))
    created_for_email = (created.filter("work_email is not null").groupBy("work_email")
                         .agg(F.min("lead_id").alias("_created"))
                         .withColumnRenamed("work_email", "_email"))
    # Only unresolved address-only batches need the created lead's id.
    out = open_.withColumn("_email", F.when(
        F.col("_lead").isNull() & ~tracked & addressed, F.col("email")))
    out = lookup(out, created_for_email, "_email", "batch_id", hot_rows=hot_rows)
    owner = F.coalesce("_lead", F.when(tracked, new_lead_id(F.col("tracking_id"))), "_created")
    method = (F.when(tracked, "tracking_id")
              .when(addressed & F.col("known_lead_id").isNotNull(), "known_visitor")
              .when(addressed, "email_capture").otherwise("anonymous"))
    return out.select(
        "batch_id", owner.alias("lead_id"),
        F.when(owner.isNull(), F.col("visitor_id")).alias("web_visitor_id"),
        method.alias("owner_method"),
        (F.col("_lead").isNull() & owner.isNotNull()).alias("is_new_lead"))


def assign_owner(events: DataFrame, leads: DataFrame, visitors: DataFrame,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stamp every event with its batch's owner.

    Signals, one row per batch, are used by several joins and their counts, so
    they are written once by ``checkpoint()`` instead of being derived from the
    events each time.
    """
    enable_checkpoints(events.sparkSession)
    signals = batch_identity_signal(events).checkpoint()
    owners = batch_owners(signals, leads, visitors, hot_rows)
    return lookup(events, owners, "batch_id", "event_id", hot_rows=hot_rows)


def leads_to_sync(leads: DataFrame, events: DataFrame, as_of, minutes: int = 10) -> DataFrame:
    """Leads with a tracking id that changed or had events lately."""
    since = before(as_of, minutes=minutes)
    tracked = leads.filter(F.col("tracking_id").isNotNull())
    recent = tracked.filter(F.col("updated_at") >= since)
    seen = tracked.join(active_lead_ids(events, since), "lead_id", "left_semi")
    return recent.unionByName(seen).dropDuplicates(["lead_id"])


def active_lead_ids(events: DataFrame, since: Column) -> DataFrame:
    return (in_period(events, since).filter(F.col("lead_id").isNotNull())
            .select("lead_id").distinct())


def new_visitors(events: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitor ids in events that the visitor table does not hold."""
    ids = events.filter(F.col("visitor_id").isNotNull()).select("visitor_id").distinct()
    return ids.join(visitors, "visitor_id", "left_anti")


def sync_candidates(leads: DataFrame, events: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Leads to serve: added lately, or ever seen on the site.

    A recent change of behaviour is an event, so it is covered by "ever seen".
    """
    added = leads.filter(F.col("created_at") >= before(as_of, days=days))
    ids = (events.filter(F.col("visitor_id").isNotNull())
           .select(F.col("visitor_id").alias("tracking_id")).distinct())
    visited = leads.join(ids, "tracking_id", "left_semi").select(*leads.columns)
    return added.unionByName(visited).dropDuplicates(["lead_id"])


def hashed_leads(leads: DataFrame) -> DataFrame:
    """``kind, hash, lead_id`` for every known address, lowest id each."""
    e = F.col("email")
    hashes = [F.struct(F.lit(k).alias("kind"), f(e).alias("hash")) for k, f in (
        ("sha256", emails.sha256_of), ("sha1", emails.sha1_of), ("md5", emails.md5_of))]
    return (lead_emails(leads).select("lead_id", F.explode(F.array(*hashes)).alias("h"))
            .groupBy("h.kind", "h.hash").agg(F.min("lead_id").alias("lead_id")))


def deanonymize(visitors: DataFrame, leads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Anonymous visitors whose address hash is that of a known lead.

    ``visitors`` has ``visitor_id, is_identified, sha256, sha1, md5``. SHA-256
    decides where it matches, then SHA-1, then MD5.
    """
    hashes = [F.struct(F.lit(i).alias("rank"), F.concat_ws(":", F.lit(k), F.col(k)).alias("tag"),
                       F.col(k).alias("hash")) for i, k in enumerate(HASH_KINDS)]
    open_ = (visitors.filter(~F.coalesce("is_identified", F.lit(False)))
             .select("visitor_id", F.explode(F.array(*hashes)).alias("h"))
             .filter(filled(F.col("h.hash")).isNotNull())
             .select("visitor_id", "h.rank", "h.tag"))
    known = hashed_leads(leads).select(F.concat_ws(":", "kind", "hash").alias("tag"), "lead_id")
    hit = lookup(open_, known, "tag", "visitor_id", how="inner", hot_rows=hot_rows)
    return (hit.groupBy("visitor_id").agg(F.min(F.struct("rank", "lead_id")).alias("_m"))
            .select("visitor_id", "_m.lead_id", F.get(
                F.array(*[F.lit(k) for k in HASH_KINDS]), F.col("_m.rank")).alias("matched_by")))


def link_sessions(events: DataFrame, matched: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Session map: session, visitor before, lead after, how, how many events.

    ``matched`` is what :func:`deanonymize` found; no address is stored.
    """
    per = (events.filter(F.col("session_id").isNotNull() & F.col("visitor_id").isNotNull())
           .groupBy("session_id", "visitor_id")
           .agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("identified_at")))
    return lookup(per, matched, "visitor_id", "session_id", how="inner", hot_rows=hot_rows).select(
        "session_id", F.col("visitor_id").alias("original_visitor_id"),
        F.col("lead_id").alias("identified_lead_id"), F.col("matched_by").alias("id_method"),
        "event_count", "identified_at")


def backfill_events(events: DataFrame, session_map: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Past anonymous events of identified sessions get the lead as owner.

    A session shared by several visitors is matched per visitor.
    """
    tag = F.concat_ws("\u0001", "session_id", "_visitor")
    known = (session_map.withColumn("_visitor", F.col("original_visitor_id"))
             .groupBy(tag.alias("_tag")).agg(F.min("identified_lead_id").alias("_lead")))
    anonymous = F.col("lead_id").isNull() & F.col("session_id").isNotNull()
    rows = (events.withColumn("_visitor", F.col("web_visitor_id"))
            .withColumn("_tag", F.when(anonymous, tag)))
    out = lookup(rows, known, "_tag", "event_id", hot_rows=hot_rows)
    return (out.withColumn("web_visitor_id", F.when(F.col("_lead").isNull(), F.col("web_visitor_id")))
            .withColumn("lead_id", F.coalesce("lead_id", "_lead"))
            .drop("_visitor", "_tag", "_lead"))


def resolve_profile(ids: DataFrame, identities: DataFrame, personal: DataFrame,
                    leads: DataFrame, visitors: DataFrame) -> DataFrame:
    """Profile of each visitor id, from the first tier that knows it.

    Tiers: identity snapshot; personalization snapshot; lead by tracking id
    (nothing seen yet: score 0, level new); identified visitor with its lead.
    An anonymous visitor, one whose lead is missing, and an unknown id are not
    personalized. Both snapshots are ``key, value_json``.
    """
    ids = ids.select(F.col("visitor_id")).filter(F.col("visitor_id").isNotNull()).distinct()
    by_tracking = (leads.filter(filled(F.col("tracking_id")).isNotNull())
                   .groupBy("tracking_id")
                   .agg(F.min_by(_lead_struct(leads), F.col("lead_id")).alias("_lead")))
    by_id = leads.select(F.col("lead_id").alias("_lead_id"), _lead_struct(leads).alias("_vlead"))
    seen = visitors.select(
        "visitor_id", F.coalesce("is_identified", F.lit(False)).alias("_identified"),
        F.col("lead_id").alias("_lead_id"), F.col("total_sessions").alias("_sessions"),
        F.col("total_pageviews").alias("_views"), F.lit(True).alias("_seen"),
        *([F.col("intent_score").alias("_score"), F.col("engagement_level").alias("_level")]
          if "intent_score" in visitors.columns
          else [F.lit(None).cast("double").alias("_score"), F.lit(None).cast("string").alias("_level")]))
    out = (ids
           .join(identities.select(F.col("key").alias("visitor_id"),
                                   F.col("value_json").alias("_id_json")), "visitor_id", "left")
           .join(personal.select(F.col("key").alias("visitor_id"),
                                 F.col("value_json").alias("_p_json")), "visitor_id", "left")
           .join(by_tracking.withColumnRenamed("tracking_id", "visitor_id"), "visitor_id", "left")
           .join(seen, "visitor_id", "left"))
    # Most visitors have no lead; a lead is reached by few visitors.
    out = lookup(out, by_id, "_lead_id", "visitor_id", hot_rows=None)
    tier = (F.when(F.col("_id_json").isNotNull(), "identity")
            .when(F.col("_p_json").isNotNull(), "personalization")
            .when(F.col("_lead").isNotNull(), "lead")
            .when(F.col("_identified") & F.col("_vlead").isNotNull(), "visitor_lead")
            .when(F.col("_identified"), "lead_missing")
            .when(F.col("_seen"), "anonymous").otherwise("unknown"))
    out = out.withColumn("source", tier)
    stored = F.when(F.col("source") == "identity", F.col("_id_json")).when(
        F.col("source") == "personalization", F.col("_p_json"))
    lead = F.when(F.col("source") == "lead", F.col("_lead")).when(
        F.col("source") == "visitor_lead", F.col("_vlead"))
    fresh = F.col("source") == "lead"
    via_visitor = F.col("source") == "visitor_lead"

    def field(name: str) -> Column:
        return F.coalesce(payload(stored, name), lead[name])

    def number(name: str, own: Column) -> Column:
        return F.coalesce(payload(stored, name).try_cast("double"),
                          F.when(fresh, F.lit(0.0)),
                          F.when(via_visitor, F.coalesce(own.cast("double"), F.lit(0.0))))

    return out.select(
        "visitor_id", "source",
        F.col("source").isin("identity", "personalization", "lead", "visitor_lead").alias("personalized"),
        *[field(n).alias(n) for n in LEAD_PROFILE],
        number("intent_score", F.col("_score")).alias("intent_score"),
        F.coalesce(payload(stored, "engagement_level"), F.when(fresh, "new"),
                   F.when(via_visitor, F.coalesce("_level", F.lit("new")))).alias("engagement_level"),
        F.when(fresh, True).otherwise(payload(stored, "is_first_visit").try_cast("boolean"))
        .alias("is_first_visit"),
        number("total_sessions", F.col("_sessions")).cast("long").alias("total_sessions"),
        number("total_pageviews", F.col("_views")).cast("long").alias("total_pageviews"))


LEAD_PROFILE = ["first_name", "last_name", "person_name", "email", "company_name", "domain",
                "company_industry", "company_revenue", *SERVED]


def _lead_struct(leads: DataFrame) -> Column:
    contact = emails.contact_email(F.col("work_email"), F.col("personal_email"))
    both = filled(F.col("first_name")).isNotNull() & filled(F.col("last_name")).isNotNull()
    return F.struct(
        filled(F.col("first_name")).alias("first_name"), filled(F.col("last_name")).alias("last_name"),
        F.when(both, F.concat_ws(" ", "first_name", "last_name")).alias("person_name"),
        contact.alias("email"), "company_name",
        F.coalesce(filled(F.col("company_website")), filled(email_domain(contact))).alias("domain"),
        *[(F.col(c) if c in leads.columns else F.lit(None).cast("string")).alias(c)
          for c in ("company_industry", "company_revenue")], *served(leads))
