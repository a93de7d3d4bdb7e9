"""Deletion by file, retention by day, layout by visitor; keys and groups over batches."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from visitlens.operators import reports, sessions
from visitlens.operators.stitching import stitch_identities
from visitlens.plans import catalog
from visitlens.sources.event_store import EventStore
from visitlens.sources.group_table import GroupTable
from visitlens.sources.key_index import KeyIndex
from visitlens.sources.snapshots import PagedSnapshot


def stored(spark, rows):
    """Rows of (batch, event id, day of January, visitor, lead)."""
    return spark.createDataFrame(rows, "batch_id string, event_id long, d int, visitor_id string, lead_id string").select(
        "batch_id", "event_id", F.expr("make_timestamp(2024, 1, d, 1, 0, 0) + make_interval(0, 0, 0, 0, 0, 0, event_id)").alias("ts"),
        "visitor_id", F.when(F.col("lead_id").isNull(), F.col("visitor_id")).alias("web_visitor_id"), "lead_id")


def contents(store):
    return sorted((r.batch_id, r.event_id) for r in store.read().collect())


@pytest.fixture()
def store(spark, tmp_path):
    out = EventStore(spark, str(tmp_path / "store"), files_per_day=3)
    out.add(stored(spark, [(f"b{v}", 100 * v + d, d, f"v{v:02}", f"L{v}" if v % 2 else None)
                           for v in range(12) for d in range(1, 5)]), "one")
    out.add(stored(spark, [(f"c{v}", 5000 + v, 4, f"v{v:02}", None) for v in range(12)]), "two")
    return out


def live_files(store):
    out = set()
    for path in store.paths():
        out |= {path} if path.endswith(".parquet") else {f"{path}/{n}" for n in store._files(path)}
    return out


def test_only_files_with_the_lead_are_written_anew(spark, store):
    before, rows = live_files(store), contents(store)
    held = {f for f in before if "L3" in pq.read_table(f.removeprefix("file:"), columns=["lead_id"])["lead_id"].to_pylist()}
    gone = spark.createDataFrame([("L3",), ("no such",), (None,)], "lead_id string")
    assert 0 < len(held) < len(before) / 2
    assert store.delete_leads(gone, "first") == len(held)
    assert contents(store) == [r for r in rows if r[0] != "b3"]
    assert before - held <= live_files(store) and not held & live_files(store)
    assert store.delete_leads(gone, "first") == 0 == store.delete_leads(gone, "again")
    # A batch whose rows were moved still replaces itself.
    store.add(stored(spark, [("b1", 7000, 2, "v01", "L1"), ("b4", 7001, 2, "v04", None)]), "three")
    assert [r for r in contents(store) if r[0] in ("b1", "b4")] == [("b1", 7000), ("b4", 7001)]
    assert len(contents(store)) == len(rows) - 4 - 8 + 2
    store.delete_leads(spark.createDataFrame([("L1",), ("L5",)], "lead_id string"), "second")
    assert not {"b1", "b3", "b5"} & {r[0] for r in contents(store)} and len(contents(store)) == len(rows) - 4 - 8 + 2 - 5
    kept = contents(store)
    store.compact()
    store.table.drop_unlisted(1)
    assert contents(store) == kept


def test_rows_that_were_replaced_do_not_come_back(spark, store):
    store.add(stored(spark, [("b3", 9000, 1, "v03", None)]), "three")
    store.delete_leads(spark.createDataFrame([("L5",)], "lead_id string"), "x")
    assert [r for r in contents(store) if r[0] == "b3"] == [("b3", 9000)]


def test_days_past_retention(spark, store):
    before = live_files(store)
    assert store.drop_days_before("2024-01-05", days=2) == ["2024-01-01", "2024-01-02"]
    assert live_files(store) == {f for f in before if "2024-01-03" in f or "2024-01-04" in f}
    assert store.drop_days_before("2024-01-05", days=2) == []


def test_history_of_a_visitor_touches_few_row_groups(spark, tmp_path, sample_dir):
    ev = catalog.events(spark, sample_dir).withColumns(
        {"web_visitor_id": F.col("visitor_id"), "lead_id": F.lit(None).cast("string")}).filter("visitor_id is not null")
    store = EventStore(spark, str(tmp_path / "store"), files_per_day=4)
    store.add(ev, "all")
    groups = touched = 0
    for f in live_files(store):
        meta = pq.ParquetFile(f.removeprefix("file:")).metadata
        at = meta.schema.names.index("visitor_id")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups, touched = groups + 1, touched + (s.min <= "v7" <= s.max)
    assert touched <= groups * 0.4
    got = reports.visitor_history(store.read(), "v7").select("event_id").collect()
    assert got == reports.visitor_history(ev, "v7").select("event_id").collect()
    plan = store.read().filter("visitor_id = 'v7'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(visitor_id,v7)" in plan


EVENTS = "visitor_id string, session_id string, raw_type string, s long, url string, data string, event_id long"


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("words", [1 << 10, 1])
def test_copies_over_batches(spark, tmp_path, words):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["s", None]), "click", rng.randrange(4) * 86_400, rng.choice(["u", None]),
             rng.choice(["{}", '{"a":1}', None]), i) for i in range(200)]
    whole = sessions.dedupe_events(frame(spark, rows))
    index, out = KeyIndex(spark, str(tmp_path / "keys"), words), None
    for n in range(0, 200, 50):
        got = index.add(frame(spark, rows[n:n + 50]), f"batch-{n}").drop("copies")
        out = got if out is None else out.unionByName(got)
    assert index.add(frame(spark, rows[:50]), "batch-0").count() > 0
    assert index.fresh(frame(spark, rows[150:])).count() == 0 == index.add(frame(spark, []), "nothing").count()
    columns = sorted(out.columns)
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_an_old_retry_opens_the_keys_of_its_day_alone(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"))
    for day in range(6):
        index.add(frame(spark, [("a", "s", "click", day * 86_400 + i, "u", "{}", 10 * day + i) for i in range(5)]), f"d{day}")
    opened, of = [], type(index.table).live

    def seen(self, kind, schema, column, keep=None, version=None):
        out = of(self, kind, schema, column, keep, version)
        opened.append((kind, len({f.split("key_day=")[1][:10] for f in out.inputFiles()})))
        return out
    index.table.live = seen.__get__(index.table)
    assert index.fresh(frame(spark, [("a", "s", "click", 86_401, "u", "{}", 99)])).count() == 0
    assert opened == [("filter", 1), ("keys", 1)]
    opened.clear()
    assert index.fresh(frame(spark, [("new", "s", "click", 86_401, "u", "{}", 99)])).count() == 1
    assert opened == [("filter", 1), ("keys", 0)]


def test_groups_by_increments(spark, tmp_path):
    rng = random.Random(9)
    links = [(f"r{rng.randint(0, 60)}", *rng.choice([("d", f"x{rng.randint(0, 45)}"), ("b", f"y{rng.randint(0, 45)}"), (None, "z")]))
             for _ in range(100)] + [(None, "d", "x1"), ("r99", "d", None)]
    schema = "record string, kind string, value string"
    table = GroupTable(spark, str(tmp_path / "g"), buckets=4, fold_every=3)
    for n in range(0, len(links), 17):
        assert table.add(spark.createDataFrame(links[n:n + 17], schema), n)
    assert not table.add(spark.createDataFrame(links[:5], schema), 0)
    got = {(r.record, r.group_id) for r in table.read().collect()}
    assert got == {(r.record, r.group_id) for r in stitch_identities(spark.createDataFrame(links, schema)).collect()}


def test_members_of_a_group_are_written_once(spark, tmp_path):
    schema = "record string, kind string, value string"
    table = GroupTable(spark, str(tmp_path / "g"), buckets=2, fold_every=100)
    table.add(spark.createDataFrame([(f"b{i}", "d", "one") for i in range(30)] + [("z", "d", "two")], schema), 0)
    table.add(spark.createDataFrame([("a", "d", "one"), ("a", "b", "three")], schema), 1)
    table.add(spark.createDataFrame([("z", "b", "three")], schema), 2)
    rows = lambda log, n: log.table.read([p for p in log.table.parts("tail") if p.name == f"batch={n}"],
                                         log._schema(log.table.version())).count()
    assert [rows(table.nodes, n) for n in (0, 1, 2)] == [33, 2, 0] and [rows(table.names, n) for n in (1, 2)] == [1, 1]
    assert {r.group_id for r in table.read().collect()} == {"a"}


def test_lost_between_nodes_and_names(spark, tmp_path, monkeypatch):
    schema = "record string, kind string, value string"
    table = GroupTable(spark, str(tmp_path / "g"), buckets=2)
    table.add(spark.createDataFrame([("c", "d", "1"), ("b", "d", "2")], schema), 0)
    more = spark.createDataFrame([("a", "d", "1"), ("a", "d", "2")], schema)

    def lost(*_):
        raise InterruptedError
    with monkeypatch.context() as m:
        m.setattr(table.names, "add", lost)
        with pytest.raises(InterruptedError):
            table.add(more, 1)
    table.add(more, 1)
    assert {(r.record, r.group_id) for r in table.read().collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_pages_of_a_version(spark, tmp_path):
    rows = [(f"L{i:03}", None if i % 11 == 0 else 1000 * (i % 7)) for i in range(100)]
    leads = spark.createDataFrame(rows, "lead_id string, s long").select("lead_id", F.timestamp_seconds("s").alias("updated_at"))
    pages = PagedSnapshot(spark, str(tmp_path / "pages"))
    cursor, got, sizes = pages.write(leads, files=4), [], []
    while cursor is not None:
        page = pages.page(cursor, 13)
        got += [r.lead_id for r in page.collect()]
        sizes.append(page.count())
        # Rows change between the pages; the reader stays with its version.
        pages.write(leads.withColumn("updated_at", F.expr("updated_at + interval 1 day")).limit(5))
        cursor = pages.after(cursor, page)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [r[0] for r in want] and sizes == [13] * 7 + [9, 0]
    assert pages.page(pages.first(), 10).count() == 5


def test_a_page_is_pushed_to_the_scan(spark, tmp_path):
    pages = PagedSnapshot(spark, str(tmp_path / "pages"))
    leads = spark.range(50).select(F.col("id").cast("string").alias("lead_id"), F.timestamp_seconds("id").alias("updated_at"))
    cursor = pages.write(leads)
    page = pages.page(pages.after(cursor, pages.page(cursor, 10)), 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "LessThanOrEqual(updated_at" in plan


def test_a_batch_of_links_is_read_once(spark, tmp_path):
    # Rows that come out anew each time they are read.
    links = spark.range(50).select(F.expr("uuid()").alias("record"), F.lit("d").alias("kind"),
                                   F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("value"))
    table = GroupTable(spark, str(tmp_path / "g"), buckets=2)
    table.add(links, 0)
    assert table.read().count() == 50
