"""Files in and out."""

import json

from pyspark.sql import functions as F

from visitlens.operators import campaigns, enrich, sessions
from visitlens.plans import catalog, flows
from visitlens.sources import readers, samples, writers


def test_batches_and_rejects(spark, tmp_path):
    good = {"events": [{"type": "pageview", "timestamp": 1700000000123, "sessionId": "s", "visitorId": None,
                        "url": "https://a.io/", "referrer": "", "data": {"a": {"b": [1, "x"]}}}],
            "meta": {"sentAt": 1700000001000}}
    bodies = [json.dumps(good), json.dumps({"events": []}), json.dumps({"meta": {}}),
              json.dumps({"events": "no"}), "not json"]
    (tmp_path / "in.json").write_text("\n".join(bodies))
    events, rejected = readers.read_event_batches(spark, str(tmp_path))
    row = events.first()
    assert events.count() == 1 and rejected.count() == 3
    assert json.loads(row.data) == {"a": {"b": [1, "x"]}} and row.visitor_id is None and row.pos == 0


def test_lead_file_spellings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Email,First Name,last_name,Company\na@b.co,"Ann ""A""",Lee,"X, Inc"\n\n'
                                    'c@d.co,,,\n')
    got = [tuple(r) for r in readers.read_campaign_leads(spark, str(tmp_path)).orderBy("email").collect()]
    assert got == [("a@b.co", 'Ann "A"', "Lee", "X, Inc"), ("c@d.co", None, None, None)]


def test_campaign_launch_round_trip(spark, tmp_path):
    leads = spark.createDataFrame([("a@b.co", 'Q "uote"', None, "X, Inc")],
                                  "email string, first_name string, last_name string, company string")
    out = flows.launch_campaign(leads, "c1", "Camp", "2024-01-01", "https://site.io", str(tmp_path), "/demo?x=1")
    # Every part file starts with the header, also one without rows; parts come in any order.
    parts = [p.read_text().splitlines() for p in (tmp_path / "links").glob("*.csv")]
    tag = out.first().short_id
    assert {part[0] for part in parts} == {'"Email","First Name","Last Name","Company","Tracking URL","Short ID"'}
    assert [line for part in parts for line in part[1:]] == [
        f'"a@b.co","Q ""uote""","","X, Inc","https://site.io/go?i={tag}&to=%2Fdemo%3Fx%3D1","{tag}"']
    row = spark.read.parquet(str(tmp_path / "identity_map")).first()
    assert (row.clicks, row.last_clicked_at, row.short_id) == (0, None, tag)
    assert spark.read.parquet(str(tmp_path / "lead_profiles")).first().engagement_level == "cold"


def test_identity_life_in_seconds(spark):
    leads = spark.createDataFrame([("a@b.co",)], "email string")
    ids = campaigns.create_identities(leads, "c", "C", "2024-01-01", days=30)
    assert writers.identity_snapshot(ids).first().ttl_seconds == 30 * 86400


def test_event_table_is_pruned_by_day(spark, sample_dir, tmp_path):
    ev = catalog.events(spark, sample_dir).withColumns(
        {"web_visitor_id": F.coalesce("visitor_id", F.lit("x")), "lead_id": F.lit(None).cast("string")})
    writers.write_events(ev, str(tmp_path / "event"))
    day = spark.read.parquet(str(tmp_path / "event")).filter("event_date = '2024-01-10'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert day.count() == ev.filter(F.to_date("ts") == "2024-01-10").count()


def test_ingest_gives_every_event_one_owner(spark, sample_dir):
    raw = catalog.raw_events(spark, sample_dir)
    again = raw.withColumn("event_id", F.col("event_id") + 10**15)
    stored = flows.ingest(raw.unionByName(again), samples.leads(spark, sample_dir),
                          samples.web_visitors(spark, sample_dir))
    assert stored.count() == raw.count()
    owners = stored.select((F.col("lead_id").isNull() != F.col("web_visitor_id").isNull()).alias("one"))
    assert owners.filter("not one").count() == 0


def test_sessions_keep_every_event(spark, sample_dir):
    ev = catalog.events(spark, sample_dir).filter("visitor_id is not null")
    cut = sessions.sessionize(ev)
    rolled = sessions.session_rollup(cut, ["visitor_id", "session_number"])
    assert rolled.agg(F.sum("events")).first()[0] == ev.count()


def test_enriched_payload_keeps_its_fields(spark):
    rows = [('{"a":{"b":1}} ', 'x"y'), ("{ }", "s"), (None, "s"), ('{"a":1}', None), ("", "s")]
    df = spark.createDataFrame(rows, "data string, session_id string").withColumns({
        "raw_type": F.lit("pageview"), "url": F.lit("::bad::"), "referrer": F.lit(None).cast("string"),
        "ip_address": F.lit(None).cast("string")})
    out = enrich.enrich_events(df).collect()
    assert [r.data and json.loads(r.data) for r in out] == [
        {"a": {"b": 1}, "_originalSessionId": 'x"y'}, {"_originalSessionId": "s"},
        {"_originalSessionId": "s"}, {"a": 1}, ""]
    assert not any(r.url_ok for r in out) and {r.path for r in out} == {None}


def test_period_prunes_days(spark, sample_dir, tmp_path):
    from visitlens.operators import profiles

    ev = catalog.events(spark, sample_dir)
    ev.withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    out = profiles.visitor_behavior(stored, "2024-01-20", days=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "(event_date" in plan and ">= 2024-01-17" in plan.split("PartitionFilters:")[1]
    assert sorted(out.collect()) == sorted(profiles.visitor_behavior(ev, "2024-01-20", days=3).collect())
