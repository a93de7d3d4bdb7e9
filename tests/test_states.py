"""Tables kept by merging: sessions over batch borders, keyed logs, failures half way."""

import random

import pytest
from pyspark.sql import functions as F

from visitlens.operators import sessions
from visitlens.sources.keyed_log import KeyedLog
from visitlens.sources.parts import PartTable
from visitlens.sources.session_table import SessionTable

EVENTS = ("visitor_id string, event_id long, s long, type string, url string, country string, city string, region string,"
          " user_agent string, device_type string, data string")


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def clicks(seed, n, visitors=6, span=400_000):
    rng = random.Random(seed)
    kinds = ["page_view", "click", "scroll_depth", "page_exit", "video_watched", "form_submit"]
    out = []
    for i in range(n):
        data = rng.choice([None, "{}", '{"depth":%d}' % rng.randint(1, 100), '{"activeTime":%d}' % rng.randint(1, 50),
                           '{"videoId":"v%d","platform":"Win"}' % rng.randint(1, 3)])
        out.append((rng.choice([None, *(f"v{k}" for k in range(visitors))]), i, rng.randrange(span), rng.choice(kinds), f"/{i}",
                    *(rng.choice([None, "", f"x{i}"]) for _ in range(3)), rng.choice([None, "Mozilla (iPhone) Mobile"]),
                    rng.choice([None, "", "tv"]), data))
    return out


def plain(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("order", ["time", "any"])
def test_batches_of_sessions_equal_one_roll_up(spark, tmp_path, order):
    rows = clicks(1, 500)
    if order == "time":
        rows.sort(key=lambda r: r[2])
    whole = sessions.session_rollup(sessions.sessionize(frame(spark, rows), 1800), ["visitor_id", "session_number"])
    table = SessionTable(spark, str(tmp_path / "t"), gap_seconds=1800, hot_rows=20)
    size = 125
    for n in range(0, len(rows), size):
        assert table.merge(frame(spark, rows[n:n + size]), f"b{n}")
        assert not table.merge(frame(spark, rows[n:n + size]), f"b{n}")
    assert plain(table.read()) == plain(whole)


def test_one_batch_bridges_two_stored_sessions(spark, tmp_path):
    def at(*seconds):
        return frame(spark, [("v", s, s, "click", f"/{s}", *[None] * 5, None) for s in seconds])

    table = SessionTable(spark, str(tmp_path / "t"), gap_seconds=100)
    table.merge(at(0, 200), "a")
    assert table.read().count() == 2
    table.merge(at(100, 10_000), "b")
    got = [(r.session_number, r.events, r.first_page, r.last_page) for r in table.read().orderBy("session_number").collect()]
    assert got == [(1, 3, "/0", "/200"), (2, 1, "/10000", "/10000")]
    table.merge(at().limit(0), "nothing")
    assert table.read().count() == 2


def test_days_out_of_reach_are_not_written_anew(spark, tmp_path):
    day = 86_400
    table = SessionTable(spark, str(tmp_path / "t"), gap_seconds=1800)
    for n in range(4):
        table.merge(frame(spark, [(v, 10 * n + i, n * day + 50_000 + i, "click", "/", *[None] * 5, None)
                                  for i, v in enumerate("vw")]), f"day-{n}")
    parts = {p.name: p.facts["values"] for p in table.table.parts("sessions")}
    assert parts == {f"part=day-{n}": [f"1970-01-0{n + 1}"] for n in range(4)}
    # A late event of the second day touches that day alone.
    table.merge(frame(spark, [("v", 99, day + 50_100, "click", "/", *[None] * 5, None)]), "late")
    parts = {p.name: p.facts["values"] for p in table.table.parts("sessions")}
    assert parts == {"part=day-0": ["1970-01-01"], "part=day-2": ["1970-01-03"], "part=day-3": ["1970-01-04"],
                     "part=late": ["1970-01-02"]}
    assert sorted(r.events for r in table.read().collect()) == [1] * 7 + [2]


def totals(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def test_folded_log_equals_one_aggregate(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(f"k{rng.randint(0, 30)}", rng.randint(0, 9), i) for i in range(20)] for _ in range(7)]
    schema = "k string, n long, last long"
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], totals, buckets=5, fold_every=3)
    assert log.read(totals(spark.createDataFrame([], schema)).schema).count() == 0
    for n, rows in enumerate(batches):
        assert log.add(totals(spark.createDataFrame(rows, schema)), n)
        assert not log.add(totals(spark.createDataFrame(rows, schema)), n)
        assert len(log.table.parts("tail")) < 3
    everything = totals(spark.createDataFrame(sum(batches, []), schema))
    assert plain(log.read()) == plain(everything)
    some = spark.createDataFrame([("k1",), ("k2",), ("no such",)], "k string")
    assert plain(log.read_for(some, everything.schema)) == plain(everything.join(some, "k", "left_semi"))
    log.fold()
    log.fold()
    assert plain(log.read()) == plain(everything) and not log.table.parts("tail")


def test_lost_driver_in_a_fold(spark, tmp_path, monkeypatch):
    schema = "k string, n long, last long"
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], totals, buckets=2, fold_every=2)
    log.add(totals(spark.createDataFrame([("a", 1, 1)], schema)), 0)
    kept = PartTable.replace

    def lost(self, df, kind, name, column, *_, **__):
        self.write(df, kind, f"part={name}", (column,))
        raise InterruptedError
    monkeypatch.setattr(PartTable, "replace", lost)
    with pytest.raises(InterruptedError):
        log.add(totals(spark.createDataFrame([("a", 2, 2), ("b", 1, 2)], schema)), 1)
    monkeypatch.setattr(PartTable, "replace", kept)
    # The batch was added before the fold was lost; neither is done twice.
    assert not log.add(totals(spark.createDataFrame([("a", 2, 2)], schema)), 1)
    assert {(r.k, r.n) for r in log.read().collect()} == {("a", 3), ("b", 1)}
    log.add(totals(spark.createDataFrame([("b", 5, 3)], schema)), 2)
    assert {(r.k, r.n) for r in log.read().collect()} == {("a", 3), ("b", 6)} and not log.table.parts("tail")


def test_only_buckets_of_the_tail_are_written_anew(spark, tmp_path):
    schema = "k string, n long, last long"
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], totals, buckets=50, fold_every=1)
    log.add(totals(spark.createDataFrame([(f"k{i}", 1, 1) for i in range(100)], schema)), 0)
    before = sum(len(p.facts["values"]) for p in log.table.parts("snapshot"))
    log.add(totals(spark.createDataFrame([("k5", 1, 2)], schema)), 1)
    parts = log.table.parts("snapshot")
    assert [len(p.facts["values"]) for p in parts] == [before - 1, 1]
    plan = log.read_for(spark.createDataFrame([("k5",)], "k string"), log.read().schema)
    assert len(plan.inputFiles()) == 1 and plan.first().n == 2


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0": ("Edge", "Windows", "desktop"),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) CriOS/120.0 Mobile/15E148 Safari/604.1": ("Chrome", "iOS", "mobile"),
    "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) Version/16.0 Mobile/15E148 Safari/604.1": ("Safari", "iOS", "tablet"),
    "Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120.0 Mobile Safari/537.36": ("Chrome", "Android", "mobile"),
    "Mozilla/5.0 (Linux; Android 13; SM-X700) SamsungBrowser/22.0 Chrome/111.0 Safari/537.36": ("Samsung Internet", "Android", "tablet"),
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.0 Safari/605.1": ("Safari", "macOS", "desktop"),
    "Mozilla/5.0 (X11; CrOS x86_64) Chrome/119.0 Safari/537.36": ("Chrome", "ChromeOS", "desktop"),
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0": ("Firefox", "Linux", "desktop"),
    "Mozilla/5.0 (compatible; Googlebot/2.1)": ("Other", "Other", "bot"), "curl/8": ("Other", "Other", "desktop"),
    "": (None, None, None), None: (None, None, None),
}


def test_agent_rules(spark):
    from visitlens.functions.events import agent_fields

    rows = spark.createDataFrame([(a,) for a in AGENTS], "a string")
    got = {r.a: (r.browser, r.operating_system, r.device) for r in rows.select(
        "a", *[c.alias(n) for n, c in agent_fields(F.col("a")).items()]).collect()}
    assert got == AGENTS
