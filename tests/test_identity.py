"""Identity, owners, the lookup cascade, stitching and snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from visitlens.operators import audiences, enrich, identity, stitching, upserts
from visitlens.plans import catalog
from visitlens.sources import samples

LEAD_COLUMNS = "lead_id string, tracking_id string, work_email string, personal_email string"


def batch(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, pos int, visitor_id string, type string, data string").select(
        "*", F.timestamp_seconds(F.col("pos")).alias("ts"), F.monotonically_increasing_id().alias("event_id"))


def test_signal_comes_from_first_event(spark):
    ev = batch(spark, [
        ("a", 1, "v2", "click", '{"tracking_id":"t2","email":"x@y.io","emailHash":"h"}'),
        ("a", 0, "v1", "page_view", '{"email":"no-at-sign"}'),
        ("a", 2, "v3", "click", '{"email":"later@y.io"}'),
        ("b", 0, None, "browser_emails_scanned", '{"emails":[{"email":"s@y.io","hash":"h2"}]}'),
        ("c", 0, "", "click", "{}")])
    got = {r.batch_id: r for r in identity.batch_identity_signal(ev).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.visitor_id, a.tracking_id, a.email, a.sha256) == ("v1", None, "x@y.io", "h")
    assert (b.visitor_id, b.email, b.sha256) == ("visitor-b", "s@y.io", "h2")
    assert (c.visitor_id, c.email) == ("visitor-c", None)


def test_owner_decisions(spark):
    leads = spark.createDataFrame([("L1", "t1", "a@x.io", None), ("L2", None, None, "b@x.io"),
                                   ("L3", None, "a@x.io", None)], LEAD_COLUMNS)
    visitors = spark.createDataFrame([("v1", True, "L9"), ("v2", False, None)],
                                     "visitor_id string, is_identified boolean, lead_id string")
    ev = batch(spark, [
        ("tracking", 0, "v1", "click", '{"tracking_id":"t1","email":"b@x.io"}'),
        ("tracking_by_email", 0, "v", "click", '{"tracking_id":"t9","email":"b@x.io"}'),
        ("known", 0, "v1", "click", '{"email":"b@x.io"}'),
        ("email", 0, "v2", "click", '{"email":"a@x.io"}'),
        ("anonymous", 0, "v1", "click", '{}'),
        ("new_tracking", 0, "v7", "click", '{"tracking_id":"t7","email":"n@x.io"}'),
        ("new_email", 1, "v8", "click", '{"email":"n@x.io"}'),
        ("new_other", 1, "v9", "click", '{"email":"o@x.io"}')])
    got = {r.batch_id: r for r in identity.assign_owner(ev, leads, visitors).collect()}
    owner = {k: (r.lead_id, r.web_visitor_id) for k, r in got.items()}
    assert owner["tracking"] == ("L1", None)
    assert owner["tracking_by_email"] == ("L2", None)
    assert owner["known"] == ("L9", None)
    assert owner["email"] == ("L1", None)
    assert owner["anonymous"] == (None, "v1")
    assert owner["new_tracking"] == owner["new_email"] and owner["new_tracking"][0].startswith("lead-")
    assert owner["new_other"][0] not in (None, owner["new_email"][0])
    valid, invalid = enrich.owner_check(identity.assign_owner(ev, leads, visitors))
    assert (valid.count(), invalid.count()) == (8, 0)


def test_owner_check_counts_empty_as_absent(spark):
    df = spark.createDataFrame([("v", ""), ("", "L"), ("v", "L"), ("", ""), (None, "")],
                               "web_visitor_id string, lead_id string")
    valid, invalid = enrich.owner_check(df)
    assert (valid.count(), invalid.count()) == (2, 3)


def test_cascade_outcomes(spark):
    leads = spark.createDataFrame(
        [("L1", "t1", "Ann", "Lee", "a@x.io"), ("L2", None, "Bo", "", "b@x.io")],
        "lead_id string, tracking_id string, first_name string, last_name string, work_email string"
    ).withColumns({c: F.lit(None).cast("string") for c in (
        "personal_email", "company_name", "company_website", "job_title", "company_industry")})
    visitors = spark.createDataFrame(
        [("via", True, "L2", 4, 9, 55.0, "warm"), ("gone", True, "L0", 1, 1, 10.0, "cold"),
         ("anon", False, None, 1, 1, 0.0, "cold")],
        "visitor_id string, is_identified boolean, lead_id string, total_sessions long,"
        " total_pageviews long, intent_score double, engagement_level string")
    ids = spark.createDataFrame([("snap", '{"first_name":"Id","intent_score":7}')], "key string, value_json string")
    personal = spark.createDataFrame([("snap", '{"first_name":"No"}'), ("pers", '{"first_name":"Pe"}')],
                                     "key string, value_json string")
    asked = spark.createDataFrame([(x,) for x in ("snap", "pers", "t1", "via", "gone", "anon", "who", "who")],
                                  "visitor_id string")
    got = {r.visitor_id: r for r in identity.resolve_profile(asked, ids, personal, leads, visitors).collect()}
    assert {k: r.source for k, r in got.items()} == {
        "snap": "identity", "pers": "personalization", "t1": "lead", "via": "visitor_lead",
        "gone": "lead_missing", "anon": "anonymous", "who": "unknown"}
    assert {k for k, r in got.items() if not r.personalized} == {"gone", "anon", "who"}
    assert (got["snap"].first_name, got["snap"].intent_score) == ("Id", 7.0)
    assert (got["t1"].person_name, got["t1"].intent_score, got["t1"].engagement_level,
            got["t1"].is_first_visit) == ("Ann Lee", 0.0, "new", True)
    assert (got["via"].first_name, got["via"].person_name, got["via"].intent_score,
            got["via"].total_sessions) == ("Bo", None, 55.0, 4)
    assert got["gone"].first_name is None and got["anon"].email is None


def groups_by_union(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for record, kind, v in links:
        find(("r", record))
        if v is not None:
            parent[find(("r", record))] = find(("k", kind, v))
    out = {}
    for record in {r for r, _, _ in links}:
        out.setdefault(find(("r", record)), []).append(record)
    return {r: min(g) for g in out.values() for r in g}


@pytest.mark.parametrize("hot_rows", [4, 10**9])
def test_stitching_against_union_find(spark, hot_rows):
    rng = random.Random(3)
    links = [(f"r{i:03}", "device", f"d{rng.randrange(90)}") for i in range(120)]
    links += [(f"r{i:03}", "email", f"e{rng.randrange(200)}") for i in range(0, 120, 2)]
    # A long chain, a key shared by many, and a record without any key.
    links += [(f"c{i:03}", "device", f"x{j}") for i in range(40) for j in (i, i + 1)]
    links += [(f"h{i:03}", "email", "shared") for i in range(60)] + [("lonely", "email", None)]
    df = spark.createDataFrame(links, "record string, kind string, value string")
    got = {r.record: r.group_id for r in stitching.stitch_identities(df, hot_rows=hot_rows).collect()}
    assert got == groups_by_union(links)


def test_same_value_of_two_kinds_is_no_link(spark):
    df = spark.createDataFrame([("a", "device", "1"), ("b", "email", "1")], "record string, kind string, value string")
    assert {r.group_id for r in stitching.stitch_identities(df).collect()} == {"a", "b"}


def same(a, b):
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(
        map(repr, b.select(*sorted(b.columns)).collect()))


def test_upserts_are_idempotent(spark, sample_dir):
    ev = catalog.events(spark, sample_dir)
    visitors, leads = samples.web_visitors(spark, sample_dir), samples.leads(spark, sample_dir)
    signals = identity.batch_identity_signal(ev)
    once = upserts.upsert_web_visitors(visitors, ev)
    assert same(once, upserts.upsert_web_visitors(once, ev))
    once = upserts.attach_email_hashes(visitors, signals)
    assert same(once, upserts.attach_email_hashes(once, signals))
    found = identity.resolve_lead(signals, leads).filter("lead_id is not null").select(
        "visitor_id", "lead_id", "ts", F.lit("m").alias("method"))
    once = upserts.identify_visitors(visitors, found)
    assert same(once, upserts.identify_visitors(once, found))
    once = upserts.upsert_leads(leads, signals)
    assert same(once, upserts.upsert_leads(once, signals))
    once = upserts.assign_tracking_ids(leads)
    assert same(once, upserts.assign_tracking_ids(once, "other"))


def test_status_update_is_per_row(spark):
    leads = spark.createDataFrame([("1", "A@x.io", "old"), ("2", "b@x.io", "old"), ("3", None, "old")],
                                  "lead_id string, email string, email_status string")
    results = enrich.map_email_status(spark.createDataFrame(
        [(" a@X.io", "valid"), ("c@x.io", "invalid")], "email string, status string"))
    got = {r.lead_id: r.email_status for r in upserts.update_email_status(leads, results).collect()}
    assert got == {"1": "verified", "2": "old", "3": "old"}


def test_conditions(spark):
    df = spark.createDataFrame([(1, "hot", True, 60.0, ""), (2, "cold", False, 50.0, "x"), (3, None, None, None, None)],
                               "id int, level string, pricing boolean, score double, name string")

    def ids(text):
        return [r.id for r in audiences.audience_filter(df, text).orderBy("id").collect()]

    assert ids("score>50") == [1] and ids("score > 49.5") == [1, 2]
    assert ids("score>=50") == [] and ids("level>1") == [] and ids("score>abc") == []
    assert ids("level=hot") == [1] and ids("level='hot'") == [] and ids("score=60") == [1]
    assert ids("pricing") == [1] and ids("name") == [2] and ids("unknown") == [] and ids("") == []
    assert ids("pricing=false") == [2]


def test_origins(spark):
    df = spark.createDataFrame([(o,) for o in (
        "https://a.site.io", "https://axsite.io", "https://site.io", "https://x.canvas.webflow.com", None)],
        "origin string")
    got = {r.origin for r in enrich.origin_allowlist(df, ["https://*.site.io"]).collect()}
    assert got == {"https://a.site.io", "https://x.canvas.webflow.com"}


def test_colliding_ids_are_counted_after_one_shuffle(spark):
    from visitlens.operators import campaigns

    rows = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 3), ("y", 3), ("z", 4), (None, 5)],
                                 "short_id string, n long")
    out = campaigns.tracking_id_collisions(rows, F.col("n"), 3)
    assert [tuple(r) for r in out.collect()] == [("x", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
