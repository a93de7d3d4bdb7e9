"""Streaming jobs over files in a given order."""

import random

from pyspark.sql import functions as F

from tests.test_behavior import greedy
from visitlens.plans import stream_queries
from visitlens.session import new_folder
from visitlens.streaming import jobs


def feed(spark, tmp_path, frames):
    """Frames as a stream, one micro-batch each."""
    path = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def click_frame(spark, rows):
    return spark.createDataFrame(rows, "session_id string, ms long").select(
        "session_id", F.timestamp_millis("ms").alias("ts"), F.col("ms").alias("event_id"),
        F.lit("click").alias("type"))


def test_rage_clicks_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    times = {}
    for s in ("a", "b"):
        t = 0
        times[s] = [t := t + rng.choice([100, 400, 499, 501, 900, 2500]) for _ in range(150)]
    rows = [(s, t) for s, ts in times.items() for t in ts]
    # Disorder of up to three seconds across files.
    rows.sort(key=lambda r: r[1] + rng.randrange(3000))
    parts = [rows[i:i + 60] for i in range(0, len(rows), 60)] + [[("end", 10**9)]]
    out = str(tmp_path / "rage")
    stream = feed(spark, tmp_path, [click_frame(spark, p) for p in parts])
    jobs.stream_rage_clicks(stream, out, delay_seconds=60).awaitTermination()
    got = {}
    log = spark.read.schema(jobs.RAGE_LOG).parquet(f"{out}/out")
    for r in log.filter("kind = 'hit'").collect():
        got.setdefault(r.session_id, []).append(r.event_id)
    assert {s: sorted(v) for s, v in got.items()} == {s: greedy(ts) for s, ts in times.items()}
    # Only the clicks around the mark stay open.
    newest = log.filter(F.col("kind") == "open").count()
    assert newest < len(rows) * len(parts)


def test_rerun_of_a_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("v", "s1", "page_view", 1), ("v", "s1", "click", 2), ("v", "s2", "click", 3)],
                               "visitor_id string, session_id string, type string, ms long"
                               ).withColumn("ts", F.timestamp_millis("ms"))
    out = str(tmp_path / "totals")
    stream = feed(spark, tmp_path, [df])
    jobs.stream_visitor_totals(stream, out).awaitTermination()
    # Fresh progress repeats every batch, as a restart after a failure may.
    (tmp_path / "totals" / "progress").rename(tmp_path / "old-progress")
    jobs.stream_visitor_totals(stream, out).awaitTermination()
    got = jobs.visitor_totals_of(jobs.visitor_sessions_log(spark, out).read()).first()
    assert (got.total_pageviews, got.total_clicks, got.total_sessions) == (1, 2, 2)


def test_identity_change_is_reported_once(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, "visitor_id string, event_id long, data string").withColumn(
            "ts", F.timestamp_seconds("event_id"))

    frames = [frame([("v", 1, "{}"), ("w", 2, '{"tracking_id":"t"}')]),
              frame([("v", 3, '{"email":"a@b.co"}'), ("w", 4, '{"email":"a@b.co"}')]),
              frame([("v", 5, '{"tracking_id":"t"}')])]
    out = str(tmp_path / "identity")
    jobs.stream_identity(feed(spark, tmp_path, frames), out).awaitTermination()
    got = {r.visitor_id: r.event_id for r in spark.read.parquet(f"{out}/out").collect()}
    assert got == {"v": 3, "w": 2}


def test_identity_stream_equals_batch_over_many_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, *"abcdefgh"]), i, rng.choice(["{}", '{"email":"a@b.co"}', '{"tracking_id":"t"}', None]))
            for i in range(120)]
    frames = [spark.createDataFrame(rows[i:i + 10], "visitor_id string, event_id long, data string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1000) - F.col("event_id") % 10 + F.lit(i * 20))) for i in range(0, 120, 10)]
    out = str(tmp_path / "identity")
    query = jobs.stream_identity(feed(spark, tmp_path, frames), out)
    query.awaitTermination()
    want = {}
    for i in range(0, 120, 10):
        for visitor, n, data in sorted((r for r in rows[i:i + 10] if r[0] and r[2] not in (None, "{}")),
                                       key=lambda r: (-(r[1] % 10), r[1])):
            if visitor not in want:
                want[visitor] = n
    assert {r.visitor_id: r.event_id for r in spark.read.parquet(f"{out}/out").collect()} == want
    # A batch reads its own file and nothing of the output.
    assert {p["numInputRows"] for p in query.recentProgress if p["numInputRows"]} == {10}


def test_hot_lead_alert_and_cooling(spark, tmp_path):
    def frame(day, **score):
        return spark.createDataFrame([(k, v) for k, v in score.items()], "lead_id string, intent_score double"
                                     ).withColumn("as_of", F.lit(f"2024-01-0{day}").cast("timestamp"))

    frames = [frame(1, a=70.0, b=10.0), frame(2, a=90.0, b=65.0), frame(3, a=20.0), frame(4, a=60.0, b=61.0)]
    out = str(tmp_path / "hot")
    jobs.stream_hot_leads(feed(spark, tmp_path, frames), out).awaitTermination()
    alerts = jobs.lead_scores_log(spark, out).outcomes(jobs.HOT)
    assert sorted((r.lead_id, r.as_of.day) for r in alerts.collect()) == [("a", 1), ("a", 4), ("b", 2)]


def test_a_batch_reads_as_much_after_many_batches(spark, tmp_path, monkeypatch):
    """Files of the log that a batch opens: the buckets of its keys and the unfolded tail."""
    read = []
    of = jobs.KeyedLog.read_for

    def counted(self, keys, schema):
        out = of(self, keys, schema)
        read.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(jobs.KeyedLog, "read_for", counted)
    frames = [spark.createDataFrame([(f"L{i % 7}", float(10 * (i % 9)))], "lead_id string, intent_score double")
              .withColumn("as_of", F.timestamp_seconds(F.lit(i * 1000))) for i in range(24)]
    out = str(tmp_path / "hot")
    jobs.stream_hot_leads(feed(spark, tmp_path, frames), out, buckets=4, fold_every=3).awaitTermination()
    assert len(read) == 24 and max(read[12:]) <= max(read[3:9]) <= 1 + 2 + 2
    last = {}
    want = []
    for i in range(24):
        lead, score = f"L{i % 7}", 10 * (i % 9)
        if score >= 60 > last.get(lead, 0):
            want.append((lead, i * 1000))
        last[lead] = score
    alerts = jobs.lead_scores_log(spark, out).outcomes(jobs.HOT).collect()
    assert sorted((r.lead_id, int(r.as_of.timestamp())) for r in alerts) == sorted(want)


def test_lateness_adds_up_to_all_rows(spark, tmp_path):
    """On time, late and dropped are all rows, whatever the disorder, and sketches say how late."""
    rng = random.Random(11)
    rows = sorted(((rng.choice(["a", "b", None]), t := rng.randrange(20_000), t + rng.choice([0, 5, 50, 3000]))
                   for _ in range(600)), key=lambda r: r[2])
    frames = [spark.createDataFrame(rows[i:i + 60], "source string, t long, sent long").select(
        "source", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("sent").alias("sent_at")) for i in range(0, 600, 60)]
    out = str(tmp_path / "late")
    jobs.stream_lateness(feed(spark, tmp_path, frames), out, F.col("source"), 40, 2000, fold_every=3).awaitTermination()
    want, newest = {}, None
    for i in range(0, 600, 60):
        for source, t, sent in rows[i:i + 60]:
            kind = "dropped" if newest is not None and t < newest - 2000 else "late" if sent - t > 40 else "on_time"
            want.setdefault(source, {"on_time": 0, "late": 0, "dropped": 0})[kind] += 1
        newest = max([newest or 0, *(t for _, t, _ in rows[i:i + 60])])
    log = jobs.lateness_log(spark, out).read()
    got = {r["source"]: {k: r[k] for k in ("on_time", "late", "dropped")} for r in log.collect()}
    assert got == want and sum(r["rows"] for r in log.collect()) == 600
    assert any(w["dropped"] for w in want.values())
    for share, least, most in ((0.2, 0, 0), (0.4, 5, 5), (0.99, 3000, 3000)):
        assert all(least <= r.delay_seconds <= most for r in jobs.watermark_delay(log, share).collect())


def test_large_periods_are_several_files(spark):
    day = F.timestamp_seconds(F.when(F.col("id") < 240_000, 1000).otherwise(stream_queries.STEP_SECONDS + 1000))
    df = spark.range(300_000).select("id", day.alias("ts"))
    sizes = []
    stream = stream_queries.as_stream(spark, df)
    path = new_folder(spark, "sizes")
    (stream.writeStream.foreachBatch(lambda b, n: sizes.append(tuple(
        b.select(F.input_file_name().alias("f")).agg(F.count("*"), F.count_distinct("f")).first())))
     .option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination())
    assert sizes == [(240_000, 3), (60_000, 3)]


def test_first_signal_of_a_visitor(spark, tmp_path):
    schema = "visitor_id string, ms long, event_id long, data string"
    frames = [spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms")) for rows in (
        [("a", 5, 2, '{"tracking_id":"late"}'), ("a", 5, 1, '{"tracking_id":"first"}'), ("a", 4, 9, "{}"),
         ("b", None, 3, '{"tracking_id":"no time"}'), ("b", 7, None, '{"email":" X@Y.z "}')],
        [("a", 1, 1, '{"tracking_id":"again"}'), ("c", 2, 1, '{"tracking_id":"c"}')])]
    out = str(tmp_path / "identity")
    jobs.stream_identity(feed(spark, tmp_path, frames), out).awaitTermination()
    got = {(r.visitor_id, r.at, r.event_id, r.tracking_id) for r in spark.read.parquet(f"{out}/out").withColumn(
        "at", F.unix_millis("ts")).collect()}
    assert got == {("a", 5, 1, "first"), ("b", 7, None, None), ("c", 2, 1, "c")}
