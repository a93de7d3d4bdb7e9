"""Sequence operators: edge cases, and hot keys giving the same as plain plans."""

import random

import pytest
from pyspark.sql import functions as F

from visitlens.operators import behavior, sessions, skew
from visitlens.plans import catalog


def events(spark, rows, columns="visitor_id string, session_id string, ms long, type string, data string"):
    df = spark.createDataFrame(rows, columns)
    return df.select("*", F.timestamp_millis("ms").alias("ts"),
                     F.row_number().over(skew.W.orderBy("ms")).cast("long").alias("event_id"))


def clicks(spark, times, session="s"):
    return events(spark, [("v", session, t, "click", None) for t in times])


def greedy(times):
    recent, hits = [], []
    for t in times:
        recent = [r for r in recent + [t] if t - r < 2000]
        if len(recent) >= 5:
            hits.append(t)
            recent = []
    return hits


def test_gap_border(spark):
    minute = 60_000
    df = events(spark, [("v", "s", t, "click", None) for t in (0, 30 * minute, 60 * minute + 1000)])
    got = [r.session_number for r in sessions.sessionize(df).orderBy("ms").collect()]
    assert got == [1, 1, 2]


def test_rage_clicks_reset(spark):
    got = behavior.rage_clicks(clicks(spark, [0, 400, 800, 1200, 1600, 1700, 5000])).collect()
    assert [int(r.ts.timestamp() * 1000) for r in got] == [1600]


def test_rage_clicks_against_brute_force(spark, monkeypatch):
    # Tiny chunks and blocks, so that states are handed on many times.
    monkeypatch.setattr(behavior, "CHUNK", 7)
    monkeypatch.setattr(behavior, "CHUNKS_PER_BLOCK", 3)
    rng = random.Random(7)
    want, frames = {}, None
    for s in range(6):
        t, times = 0, []
        for _ in range(400):
            t += rng.choice([50, 300, 450, 499, 501, 700, 2500] if s else [100])
            times.append(t)
        want[f"s{s}"] = greedy(times)
        df = clicks(spark, times, f"s{s}")
        frames = df if frames is None else frames.unionByName(df)
    frames = frames.withColumn("event_id", F.col("ms"))
    for hot_rows in (10, 10**9):
        got = {}
        for r in behavior.rage_clicks(frames, hot_rows=hot_rows).collect():
            got.setdefault(r.session_id, []).append(r.event_id)
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_scroll_jump(spark):
    rows = [("v", "s", t, "scroll_depth", f'{{"depth":{d}}}') for t, d in ((1, 20), (2, 60), (3, 50), (4, 90))]
    got = [r.milestone for r in behavior.scroll_milestones(events(spark, rows)).orderBy("ts", "milestone").collect()]
    assert got == [25, 50, 75, 90]
    exact = [r.milestone for r in behavior.scroll_milestones(events(spark, rows), exact=True).collect()]
    assert exact == [90]


def test_video_watched_labels(spark):
    def sample(session, t, at, length):
        return ("v", session, t, "video_progress", f'{{"videoId":"m","currentTime":{at},"duration":{length}}}')

    rows = [sample("long", 1, 5, 100), sample("long", 2, 10, 100), sample("short", 1, 3, 10),
            sample("none", 1, 3, 0)]
    got = {(r.session_id, r.milestone): r.threshold
           for r in behavior.video_milestones(events(spark, rows)).collect()}
    assert got == {("long", "watched"): "time", ("short", "watched"): "percentage",
                   ("short", "progress_25"): None}


def test_backtracking(spark):
    df = events(spark, [("v", "s", i, "page_view", None) for i in range(7)]).withColumn(
        "path", F.element_at(F.array(*[F.lit(p) for p in "ABAACAB"]), F.col("ms").cast("int") + 1))
    got = [r.is_backtracking for r in behavior.page_path(df).orderBy("ms").collect()]
    assert got == [False, False, True, False, False, True, True]


def test_same_video_counts_once(spark):
    rows = [("v", "s", t, "video_watched", '{"videoId":"m"}') for t in (1, 2)]
    df = events(spark, rows).withColumns({"url": F.lit("u"), "country": F.lit(None).cast("string"),
                                          "user_agent": F.lit(None).cast("string")})
    assert sessions.session_rollup(df, ["session_id"]).first().videos_watched == 1


def test_visitor_key_is_one_per_session(spark):
    rows = [(None, "s", 1, "click", '{"deviceFingerprint":"d"}'),
            (None, "s", 2, "page_view", '{"browserId":"b","deviceFingerprint":"d"}'),
            (None, None, 3, "click", '{"deviceFingerprint":"d"}'), ("v", "s", 4, "click", None)]
    got = [r.visitor_key for r in sessions.visitor_key(events(spark, rows)).orderBy("ms").collect()]
    assert got == ["b", "b", "d", "v"]


def test_active_time_skips_hidden(spark):
    rows = [("v", "s", t * 1000, k, None) for t, k in (
        (0, "page_view"), (10, "focus_lost"), (15, "click"), (30, "focus_gained"), (37, "page_exit"))]
    assert behavior.active_time(events(spark, rows)).first().active_seconds == 17


def test_reading_borders(spark):
    rows = [("v", "s", t * 1000, "scroll_depth", None, s) for t, s in (
        (1, 10), (2, 310), (3, 320), (4, 700), (5, 800))]
    df = events(spark, rows, "visitor_id string, session_id string, ms long, type string, data string, scroll int")
    got = behavior.reading_time(df).first()
    # 300 pixels is neither; 10, 10 and 100 are reading; 380 is scanning.
    assert (got.reading_time, got.scanning_time) == (3, 1)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("job", [
    lambda e, n: sessions.sessionize(e, 6 * 3600, hot_rows=n).select("event_id", "session_number"),
    lambda e, n: behavior.visit_number(e, "visitor_id", hot_rows=n).select("event_id", "visit_number"),
    lambda e, n: behavior.page_path(e, "visitor_id", hot_rows=n).select(
        "event_id", "previous_page", "is_backtracking"),
    lambda e, n: behavior.device_history(e, hot_rows=n),
    lambda e, n: behavior.device_switches(e, hot_rows=n),
    lambda e, n: behavior.rage_clicks(e.withColumn("ts", F.timestamp_micros(
        F.floor(F.unix_micros("ts") / 200_000))), "visitor_id", hot_rows=n),
    lambda e, n: behavior.scroll_milestones(e, "visitor_id", hot_rows=n),
    lambda e, n: behavior.page_engagement(e, "visitor_id", hot_rows=n),
    lambda e, n: behavior.active_time(e, "visitor_id", hot_rows=n),
    lambda e, n: sessions.visitor_key(e, hot_rows=n).select("event_id", "visitor_key"),
], ids=["sessionize", "visit_number", "page_path", "device_history", "device_switches", "rage_clicks",
        "scroll", "page_engagement", "active_time", "visitor_key"])
def test_hot_keys_give_the_same(spark, sample_dir, job):
    """A third of all rows on one visitor; every limit so low that it is hot."""
    ev = catalog.events(spark, sample_dir)
    skewed = ev.withColumn("visitor_id", F.when(F.col("event_id") % 3 == 0, "v1").otherwise(
        F.col("visitor_id")))
    assert rows(job(skewed, 20)) == rows(job(skewed, 10**9))


def test_along_keeps_null_values(spark):
    df = events(spark, [("v", "s", i * 3_600_000, "click", None if i % 3 else str(i)) for i in range(30)])
    steps = {"before": skew.Previous(F.col("data")), "after": skew.Following(F.col("data")),
             "tail": skew.Trailing(F.col("ms"), 3)}
    order = ["ts", "event_id"]
    hot = skew.heavy_keys(df, ["visitor_id"], 1)
    plain = skew.along(df, ["visitor_id"], order, steps)
    for slices in (2, 5, 100):
        cut = skew.along(df, ["visitor_id"], order, steps, skew.Hot(hot.keys, hot.count, slices))
        assert rows(cut.select(*plain.columns)) == rows(plain)


def test_a_burst_at_one_time_runs_in_many_slices(spark):
    """One visitor with two thirds of all rows, half of them in the same second."""
    df = events(spark, [("v", "s", 5_000 if i % 2 else 40 * i, "click", str(i)) for i in range(400)]
                + [(f"w{i}", "s", i, "click", None) for i in range(200)])
    order, hot = ["ts", "event_id"], skew.heavy_keys(df, ["visitor_id"], 50)
    assert (hot.count, hot.slices) == (1, 10)
    cut = skew._sliced(df, ["visitor_id"], order, hot)
    sizes = [r["count"] for r in cut.filter("_n is not null").groupBy("_slice").count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 10 and max(sizes) <= 60
    by_slice = [r[0] for r in cut.filter("_n is not null").orderBy(*order).select("_slice").collect()]
    assert by_slice == sorted(by_slice)
    steps = {"before": skew.Previous(F.col("data")), "sum": skew.RunningSum(F.lit(1)), "top": skew.RunningMax(F.col("event_id"))}
    plain = skew.along(df, ["visitor_id"], order, steps)
    assert rows(skew.along(df, ["visitor_id"], order, steps, hot).select(*plain.columns)) == rows(plain)


def test_places_among_many_cuts(spark):
    cuts = [10 * i for i in range(100)]
    df = spark.createDataFrame([(v,) for v in range(-5, 1005, 7)], "v long").select(
        "v", F.array(*map(F.lit, cuts)).alias("cuts"), F.array(*map(F.lit, cuts[::skew.STEP])).alias("coarse"))
    for r in df.select("v", skew._places(F.col("cuts"), F.col("coarse"), F.col("v")).alias("n")).collect():
        assert r.n == sum(c <= r.v for c in cuts)


def test_lookup_spreads_hot_and_null_keys(spark):
    facts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("4", 2), ("none", 3)], "k string, x int")
    want = rows(facts.join(table, "k", "left").select("id", "k", "x"))
    for hot_rows in (5, 10**9):
        assert rows(skew.lookup(facts, table, "k", "id", hot_rows=hot_rows).select("id", "k", "x")) == want
