"""The stored event table: commits, batches sent again, failures half way."""

import json

import pytest
from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.operators import enrich, identity
from visitlens.plans import flows
from visitlens.sources import readers, samples
from visitlens.sources.event_store import EventStore
from visitlens.sources.parts import Part, PartTable

EMPTY_LEADS = "lead_id string, tracking_id string, work_email string, personal_email string"
EMPTY_VISITORS = "visitor_id string, is_identified boolean, lead_id string"


def envelope(batch, *events, at=1000, city="Rome"):
    body = events[0] if isinstance(events[0], str) else json.dumps({"events": list(events), "meta": {"sentAt": at}})
    return (batch, body, {"ip_address": "1.2.3.4", "city": city, "asn": 7, "is_eu_country": True}, at)


def event(kind="pageview", at=1, session="s", visitor="v", **data):
    return {"type": kind, "timestamp": at, "sessionId": session, "visitorId": visitor, "url": "https://a.io/x",
            "referrer": "", "data": data}


def received(spark, *envelopes):
    rows = spark.createDataFrame(list(envelopes), schemas.ENVELOPE)
    return rows.withColumn("received_at", F.timestamp_millis("received_at"))


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([("L1", "t1", "a@b.co", None)], EMPTY_LEADS), spark.createDataFrame([], EMPTY_VISITORS)


def test_signals_of_whole_batches_equal_those_of_events(spark, sample_dir):
    good, _ = readers.parsed_envelopes(samples.request_envelopes(spark, sample_dir))
    whole = identity.envelope_signals(good).drop("batch_session_id")
    rows = identity.batch_identity_signal(enrich.typed(readers.unfolded_envelopes(good)))
    assert sorted(map(str, whole.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_scanned_address_comes_from_the_first_event_that_has_one(spark):
    scan = event("browser_emails_scanned", emails=[{"email": "s@x.io", "hash": "h"}, {"email": "t@x.io"}])
    good, bad = readers.parsed_envelopes(received(
        spark, envelope("a", event(email="none"), scan, event(email="late@x.io", sha1="q")), envelope("b", "no json"),
        envelope("c", '{"events":[]}')))
    row = identity.envelope_signals(good).collect()
    assert [(r.batch_id, r.email, r.sha256, r.sha1) for r in row] == [("a", "s@x.io", "h", None)]
    assert [r.batch_id for r in bad.collect()] == ["b"]


def test_batches_replace_themselves(spark, tmp_path, people):
    store = EventStore(spark, str(tmp_path / "store"))
    first = [envelope("a", event(at=1), event("click", at=2)), envelope("a", event(at=1), event("click", at=2)),
             envelope("b", event(at=3, tracking_id="t1")), envelope("c", event(email="new@x.io"))]
    rejected = flows.ingest_batches(received(spark, *first, envelope("x", '{"events":1}')), *people, store, "1")
    assert [r.batch_id for r in rejected.collect()] == ["x"]
    rows = {(r.batch_id, r.pos): r for r in store.read().collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", 0), ("c", 0)}
    assert rows["a", 0].web_visitor_id == "v" and rows["b", 0].lead_id == "L1" and rows["c", 0].lead_id.startswith("lead-")
    assert rows["a", 1].city == "Rome" and rows["a", 1].asn == 7 and json.loads(rows["a", 0].data)["_originalSessionId"] == "s"
    ids = {k: r.event_id for k, r in rows.items()}
    assert len(set(ids.values())) == 4
    # The same commit again changes nothing; the batch in another commit takes its own place.
    flows.ingest_batches(received(spark, *first), *people, store, "1")
    flows.ingest_batches(received(spark, envelope("a", event(at=1), event("click", at=2), city="Oslo")), *people, store, "2")
    again = {(r.batch_id, r.pos): r for r in store.read().collect()}
    assert {k: r.event_id for k, r in again.items()} == ids
    assert [again["a", i].city for i in (0, 1)] == ["Oslo", "Oslo"] and again["b", 0].city == "Rome"
    flows.ingest_batches(received(spark, envelope("a", event(at=1), city="Bern")), *people, store, "3")
    assert {(r.batch_id, r.pos, r.city) for r in store.read().collect()} == {
        ("a", 0, "Bern"), ("b", 0, "Rome"), ("c", 0, "Rome")}
    before = sorted(map(str, store.read().drop("commit").collect()))
    store.compact()
    assert sorted(map(str, store.read().drop("commit").collect())) == before
    assert not store.table.parts("replaced")
    # Commits folded into one are still known.
    flows.ingest_batches(received(spark, *first), *people, store, "2")
    assert sorted(map(str, store.read().drop("commit").collect())) == before
    flows.ingest_batches(received(spark, envelope("b", event(at=3), city="Bonn")), *people, store, "4")
    assert {(r.batch_id, r.city) for r in store.read().collect()} == {("a", "Bern"), ("b", "Bonn"), ("c", "Rome")}


def test_last_received_copy_of_a_batch_counts(spark, tmp_path, people):
    store = EventStore(spark, str(tmp_path / "store"), files_per_day=2)
    flows.ingest_batches(received(spark, envelope("a", event(), at=5, city="late"), envelope("a", event(), at=4, city="early")),
                         *people, store, "1")
    assert [r.city for r in store.read().collect()] == ["late"]


def test_lost_driver_leaves_nothing_to_read(spark, tmp_path, people, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"))
    flows.ingest_batches(received(spark, envelope("a", event())), *people, store, "1")

    def lost(*_):
        raise InterruptedError
    with monkeypatch.context() as m:
        m.setattr(PartTable, "publish", lost)
        with pytest.raises(InterruptedError):
            flows.ingest_batches(received(spark, envelope("b", event())), *people, store, "2")
    assert [r.batch_id for r in store.read().collect()] == ["a"]
    flows.ingest_batches(received(spark, envelope("b", event()), envelope("c", event())), *people, store, "2")
    assert sorted(r.batch_id for r in store.read().collect()) == ["a", "b", "c"]


def test_two_writers_and_clean_up(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"))
    rows = spark.range(3)
    for n in range(3):
        table.write(rows, "k", f"p{n}")
        table.publish([Part("k", f"p{n}")], n)
    with pytest.raises(RuntimeError):
        table.publish([], 1)
    table.write(rows, "k", "left-over")
    assert table.read(table.parts("k"), "id bigint").count() == 3 and table.version() == 3
    assert sorted(p.rsplit("/", 1)[1] for p in table.drop_unlisted(1)) == ["left-over", "p0", "p1"]
    assert table.read(table.parts("k"), "id bigint").count() == 3


def test_envelopes_from_files(spark, tmp_path):
    lines = [{"batch_id": "a", "body": "{}", "request": {"city": "Rome"}, "received_at": 1}, {"body": "{}", "received_at": 2}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.read_envelopes(spark, str(tmp_path)).collect()
    assert {(len(r.batch_id), r.request and r.request.city) for r in rows} == {(1, "Rome"), (64, None)}


def test_bodies_are_parsed_once(spark):
    good, _ = readers.parsed_envelopes(received(spark, envelope("a", event())))
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
