"""End-to-end flows: ingest, profile build, profile lookup, campaign launch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.functions import urls
from visitlens.functions.scalars import filled, payload_struct
from visitlens.operators import campaigns, enrich, identity, profiles, sessions
from visitlens.session import new_folder
from visitlens.sources import readers, writers
from visitlens.sources.event_store import EventStore


def with_devices(events: DataFrame) -> DataFrame:
    """Device and browser columns out of the payload, in one parse."""
    fields = payload_struct(
        F.col("data"), "deviceFingerprint string, browserId string, tracking_id string")
    return events.withColumn("_p", fields).withColumns({
        "device_fingerprint": filled(F.col("_p.deviceFingerprint")),
        "browser_id": filled(F.col("_p.browserId")),
        "tracking_id": filled(F.col("_p.tracking_id")),
    }).drop("_p")


def ingest(raw: DataFrame, leads: DataFrame, visitors: DataFrame) -> DataFrame:
    """Raw events to stored events: no copies, enriched, one owner each."""
    enriched = enrich.enrich_events(sessions.dedupe_events(raw).drop("copies"))
    owned = identity.assign_owner(enriched, leads, visitors)
    valid, _ = enrich.owner_check(owned)
    return valid


#: Columns of a stored event, besides the request's and the campaign parameters.
STORED = ["event_id", "batch_id", "pos", "ts", "sent_at", "received_at", "type", "category", "session_id", "lead_id",
          "web_visitor_id", "visitor_id", "url", "path", "url_ok", "referrer", "data", "company_identifier",
          "url_parms", "campaign_id", "message_id"]


def stored_events(envelopes: DataFrame, leads: DataFrame, visitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored events, rejected envelopes) of received envelopes; see :func:`readers.parsed_envelopes`.

    Batches stay one row each until their owner is known, so the joins with leads and
    visitors move a short row per batch. All events of a batch go to the session of its first
    one; the payload keeps their own.
    """
    landing = new_folder(envelopes.sparkSession, "landed-batches")
    good, rejected = readers.parsed_envelopes(envelopes)
    # Read three times from here on: for the signals, for the owners and for the events.
    good.write.parquet(landing)
    good = envelopes.sparkSession.read.parquet(landing)
    signals_at = new_folder(envelopes.sparkSession, "batch-signals")
    identity.envelope_signals(good).write.parquet(signals_at)
    signals = envelopes.sparkSession.read.parquet(signals_at)
    owners = identity.batch_owners(signals, leads, visitors).join(
        signals.select("batch_id", "batch_session_id"), "batch_id")
    events = readers.unfolded_envelopes(good.join(owners, "batch_id"))
    enriched = enrich.enrich_events(events).withColumn("session_id", F.col("batch_session_id"))
    valid, _ = enrich.owner_check(enriched)
    request = [f.name for f in schemas.REQUEST.fields]
    return valid.select(*STORED, *urls.STORED_CAMPAIGN_PARAMS, *request), rejected


def ingest_batches(envelopes: DataFrame, leads: DataFrame, visitors: DataFrame, store: EventStore,
                   commit: str) -> DataFrame:
    """Store received envelopes as one commit; returns the rejected ones.

    A commit that is stored already is not stored again; a batch that is, replaces itself.
    """
    events, rejected = stored_events(envelopes, leads, visitors)
    if commit not in store.commits():
        store.add(events, commit)
    return rejected


def build_profiles(events: DataFrame, leads: DataFrame, members: DataFrame, as_of,
                   days: int = 90) -> DataFrame:
    """Served profile of every lead from its behaviour and campaigns."""
    behavior = profiles.visitor_behavior(events, as_of, days)
    return profiles.lead_profile_build(leads, behavior, profiles.campaign_summary(members))


def serve_profiles(profile_rows: DataFrame, path: str, as_of) -> None:
    """Write the serving snapshot of built profiles."""
    writers.write_profile_snapshot(
        writers.profile_snapshot(profile_rows, "tracking_id", as_of), path)


def launch_campaign(leads: DataFrame, campaign_id: str, campaign_name: str, created_at,
                    base_url: str, folder: str, destination: str = "/") -> DataFrame:
    """Identities of a campaign, with its link file, identity map and profiles."""
    identities = campaigns.create_identities(leads, campaign_id, campaign_name, created_at)
    writers.write_campaign_urls(identities, base_url, f"{folder}/links", destination)
    writers.write_identity_map(identities, f"{folder}/identity_map")
    writers.init_lead_profiles(identities, f"{folder}/lead_profiles")
    return identities
