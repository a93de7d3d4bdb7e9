"""Streaming jobs.

Every job takes a streaming DataFrame and a folder for its output and
checkpoint, both on storage all executors share, and returns the started query.
``trigger`` is ``availableNow`` by default: process what is there, then stop.

Jobs that keep running results by key do so in a :class:`KeyedLog`: a batch is a small part
of its own, parts are folded into a bucketed snapshot every few batches, and a batch reads
the buckets of its own keys and what isn't folded yet, in the first week as after a
year. A batch that is run again after a failure counts once. Who was identified before is
kept in the state store, one value per visitor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from visitlens.functions import scores
from visitlens.functions.scalars import filled, payload
from visitlens.operators import enrich
from visitlens.operators.behavior import RAGE_MILLIS, rage_clicks
from visitlens.sources.keyed_log import KeyedLog

NOW = {"availableNow": True}

RAGE_LOG = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType())])


def _append(df: DataFrame, folder: str, trigger: dict | None) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
            .trigger(**(trigger or NOW)).start())


def _log(df: DataFrame, folder: str, part: Callable[[DataFrame, int], DataFrame],
         trigger: dict | None) -> StreamingQuery:
    """Write ``part(batch, n)`` to ``out/batch=n``, replacing an earlier try."""
    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            part(batch, n).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        finally:
            batch.unpersist()

    return _each(df, folder, run, trigger)


def _each(df: DataFrame, folder: str, run: Callable[[DataFrame, int], None], trigger: dict | None) -> StreamingQuery:
    return (df.writeStream.foreachBatch(run)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(**(trigger or NOW)).start())


def _earlier(batch: DataFrame, folder: str, n: int, schema: T.StructType,
             only: int | None = None) -> DataFrame:
    """What the log holds from the batches before ``n``, or from one of them."""
    spark = batch.sparkSession
    if n == 0:
        return spark.createDataFrame([], schema)
    stored = T.StructType(schema.fields + [T.StructField("batch", T.IntegerType())])
    wanted = F.col("batch") < n if only is None else F.col("batch") == only
    return spark.read.schema(stored).parquet(f"{folder}/out").filter(wanted).drop("batch")


def stream_ingest(raw: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Enrich events and append them by day."""
    out = enrich.enrich_events(raw).withColumn("event_date", F.to_date("ts"))
    return (out.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
            .trigger(**(trigger or NOW)).start())


def stream_dedupe(raw: DataFrame, folder: str, delay: str = "1 hour",
                  trigger: dict | None = None) -> StreamingQuery:
    """Drop copies of events that are resent within ``delay``.

    The watermark must cover the real disorder: rows older than it are dropped.
    :func:`late_events` shows how many those are.
    """
    keyed = raw.withColumn("_d", F.sha2("data", 256)).withWatermark("ts", delay)
    out = keyed.dropDuplicatesWithinWatermark(
        ["visitor_id", "session_id", "raw_type", "ts", "url", "_d"]).drop("_d")
    return _append(out, folder, trigger)


def stream_sessions(events: DataFrame, folder: str, gap: str = "30 minutes", delay: str = "1 hour",
                    key: str = "visitor_id", trigger: dict | None = None) -> StreamingQuery:
    """Sessions by inactivity gap, each written once it can no longer grow."""
    out = (events.filter(F.col(key).isNotNull()).withWatermark("ts", delay)
           .groupBy(key, F.session_window("ts", gap).alias("w"))
           .agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
                F.count(F.lit(1)).alias("events"),
                F.count_if(F.col("type") == "page_view").alias("pageviews"),
                F.count_if(F.col("type") == "click").alias("clicks"))
           .drop("w"))
    return _append(out, folder, trigger)


def visitor_sessions_log(spark: SparkSession, folder: str, **settings) -> KeyedLog:
    """Totals by visitor and session; by session, as one seen in two batches still is one."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("visitor_id", "session_id").agg(
            F.sum("pageviews").alias("pageviews"), F.sum("clicks").alias("clicks"),
            F.max("last_seen_at").alias("last_seen_at"))

    return KeyedLog(spark, f"{folder}/log", ["visitor_id"], merge, **settings)


def stream_visitor_totals(events: DataFrame, folder: str, trigger: dict | None = None, **settings) -> StreamingQuery:
    """Keep visitor totals; read them with ``visitor_totals_of(visitor_sessions_log(spark, folder).read())``."""
    def run(batch: DataFrame, n: int) -> None:
        visitor_sessions_log(batch.sparkSession, folder, **settings).add(
            batch.filter(F.col("visitor_id").isNotNull())
            .groupBy("visitor_id", "session_id")
            .agg(F.count_if(F.col("type") == "page_view").alias("pageviews"),
                 F.count_if(F.col("type") == "click").alias("clicks"),
                 F.max("ts").alias("last_seen_at")), n)

    return _each(events, folder, run, trigger)


def visitor_totals_of(log: DataFrame) -> DataFrame:
    return log.groupBy("visitor_id").agg(
        F.sum("pageviews").alias("total_pageviews"), F.sum("clicks").alias("total_clicks"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.max("last_seen_at").alias("last_seen_at"))


def stream_recent_leads(events: DataFrame, folder: str, length: str = "10 minutes",
                        slide: str = "5 minutes", delay: str = "1 hour",
                        trigger: dict | None = None) -> StreamingQuery:
    """Leads with events in each look-back window, every five minutes."""
    out = (events.filter(F.col("lead_id").isNotNull()).withWatermark("ts", delay)
           .groupBy(F.window("ts", length, slide).alias("w"), "lead_id")
           .agg(F.count(F.lit(1)).alias("events"))
           .select(F.col("w.start").alias("window_start"), "lead_id", "events"))
    return _append(out, folder, trigger)


def stream_rage_clicks(events: DataFrame, folder: str, key: str = "session_id",
                       delay_seconds: int = 3600, trigger: dict | None = None) -> StreamingQuery:
    """The fifth click inside two seconds, whatever order clicks arrive in.

    A click is judged once the greatest time seen is ``delay_seconds`` ahead of
    it; clicks arriving later than that are dropped. The log holds, per batch:
    ``hit`` rows; ``open`` rows, the clicks the next batch starts from; and one
    ``mark`` row, the time up to which clicks were judged. Open are the clicks
    not judged yet, and judged ones after a session's last hit that are under
    two seconds older than the mark: fewer than five per session. As counting
    starts anew after a hit, nothing else has to be remembered, and hits come
    from the batch operator, which splits a hot session over tasks.
    """
    clicks = events.filter((F.col("type") == "click") & F.col(key).isNotNull()).select(
        F.col(key).alias("session_id"), "ts", "event_id", "type")

    def part(batch: DataFrame, n: int) -> DataFrame:
        before = _earlier(batch, folder, n, RAGE_LOG, only=n - 1)
        old_mark = before.filter("kind = 'mark'").select("ts").first()
        old_mark = F.lit(old_mark[0] if old_mark else None).cast("timestamp")
        fresh = batch.filter(old_mark.isNull() | (F.col("ts") > old_mark))
        rows = before.filter("kind = 'open'").select(
            "session_id", "ts", "event_id", F.lit("click").alias("type")).unionByName(fresh)
        newest = fresh.agg(F.max("ts")).first()[0]
        mark = F.greatest(old_mark, F.timestamp_micros(
            F.unix_micros(F.lit(newest).cast("timestamp")) - delay_seconds * 1_000_000))
        judged = rows.filter(F.col("ts") <= mark)
        hits = rage_clicks(judged, "session_id")
        last = hits.groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("_last"))
        recent = judged.filter(
            F.unix_millis("ts") > F.unix_millis(mark) - RAGE_MILLIS).join(last, "session_id", "left")
        open_ = rows.filter(mark.isNull() | (F.col("ts") > mark)).unionByName(
            recent.filter(F.col("_last").isNull() | (F.struct("ts", "event_id") > F.col("_last")))
            .drop("_last"))
        marked = batch.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("session_id"), mark.alias("ts"),
            F.lit(None).cast("long").alias("event_id"), F.lit("mark").alias("kind"))
        return (hits.select("session_id", "ts", "event_id", F.lit("hit").alias("kind"))
                .unionByName(open_.select("session_id", "ts", "event_id", F.lit("open").alias("kind")))
                .unionByName(marked))

    return _log(clicks, folder, part, trigger)


# Times as microseconds, which Python workers pass on as they are.
SIGNAL = T.StructType([
    T.StructField("visitor_id", T.StringType()), T.StructField("us", T.LongType()),
    T.StructField("event_id", T.LongType()), T.StructField("tracking_id", T.StringType()),
    T.StructField("email_sha256", T.StringType())])


class FirstSignal(StatefulProcessor):
    """Passes the first signal of a visitor and remembers that there was one."""

    def __init__(self, ttl_millis: int | None):
        self.ttl_millis = ttl_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "event_id long", self.ttl_millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r.us is None, r.us or 0, r.event_id is None, r.event_id or 0))
        self.seen.update((first.event_id,))
        yield first

    def close(self) -> None:
        pass


def _first_of_each(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First signal per visitor of each batch of rows, so that a hot visitor is a row per some thousand."""
    for rows in some:
        yield rows.sort_values(["us", "event_id"], kind="stable").drop_duplicates("visitor_id")


def stream_identity(events: DataFrame, folder: str, trigger: dict | None = None,
                    ttl_days: int | None = None) -> StreamingQuery:
    """One row when a visitor turns from anonymous to identified.

    Who was reported is one value per visitor in the state store, checkpointed by the stream, so a
    batch reads nothing of earlier ones. With ``ttl_days`` a visitor is forgotten after that
    time and reported again.
    """
    spark = events.sparkSession
    data = F.col("data")
    tracking = filled(payload(data, "tracking_id"))
    address = F.when(payload(data, "email").contains("@"), payload(data, "email"))
    signals = events.select(
        "visitor_id", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"),
        tracking.alias("tracking_id"),
        F.sha2(F.lower(F.trim(address)), 256).alias("email_sha256")).filter(
        F.col("visitor_id").isNotNull()
        & (F.col("tracking_id").isNotNull() | F.col("email_sha256").isNotNull()))
    ttl = ttl_days * 86_400_000 if ttl_days else None
    # Rows, not frames: most visitors have one, and a frame for each costs more than all the rest.
    changes = (signals.mapInPandas(_first_of_each, SIGNAL).groupBy("visitor_id")
               .transformWithState(FirstSignal(ttl), SIGNAL, "Append", "ProcessingTime" if ttl else "None")
               .select("visitor_id", F.timestamp_micros("us").alias("ts"), "event_id", "tracking_id", "email_sha256"))
    # A running query keeps the settings it was started with.
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _append(changes, folder, trigger)
    finally:
        spark.conf.set(store, before)


HOT = T.StructType([
    T.StructField("lead_id", T.StringType()), T.StructField("as_of", T.TimestampType()),
    T.StructField("intent_score", T.DoubleType())])


def lead_scores_log(spark: SparkSession, folder: str, **settings) -> KeyedLog:
    """Latest score of each lead; the outcomes are the alerts."""
    def merge(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("lead_id").agg(F.max(F.struct("as_of", "intent_score")).alias("_p"))
                .select("lead_id", "_p.as_of", "_p.intent_score"))

    return KeyedLog(spark, f"{folder}/log", ["lead_id"], merge, **settings)


def stream_hot_leads(profile_updates: DataFrame, folder: str, trigger: dict | None = None,
                     **settings) -> StreamingQuery:
    """Alert when a lead becomes hot; ``lead_id, as_of, intent_score`` comes in.

    Read alerts with ``lead_scores_log(spark, folder).outcomes(HOT)``.
    """
    def run(batch: DataFrame, n: int) -> None:
        log = lead_scores_log(batch.sparkSession, folder, **settings)
        if log.holds(n):
            return
        latest = log.merge(batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HOT])).persist()
        try:
            before = log.read_for(latest, HOT).select("lead_id", F.col("intent_score").alias("_before"))
            hot = F.col("intent_score") >= scores.HOT_SCORE
            was = F.coalesce(F.col("_before") >= scores.HOT_SCORE, F.lit(False))
            alerts = latest.join(before, "lead_id", "left").filter(hot & ~was).drop("_before")
            log.add(latest, n, alerts)
        finally:
            latest.unpersist()

    return _each(profile_updates, folder, run, trigger)


def late_events(events: DataFrame, folder: str, bound_seconds: int = 3600,
                trigger: dict | None = None) -> StreamingQuery:
    """Events sent more than ``bound_seconds`` after they happened."""
    lag = F.unix_micros("sent_at") - F.unix_micros("ts")
    out = events.withColumn("late_seconds", F.floor(lag / F.lit(1_000_000)).cast("long"))
    return _append(out.filter(lag > F.lit(bound_seconds * 1_000_000)), folder, trigger)


LATENESS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("on_time", T.LongType()), T.StructField("late", T.LongType()),
    T.StructField("dropped", T.LongType()), T.StructField("newest", T.TimestampType()),
    T.StructField("sketch", T.BinaryType())])


def lateness_log(spark: SparkSession, folder: str, **settings) -> KeyedLog:
    """Counts and a mergeable sketch of lateness (milliseconds from event to sending) per source."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source").agg(
            *[F.sum(c).alias(c) for c in ("rows", "on_time", "late", "dropped")], F.max("newest").alias("newest"),
            F.kll_merge_agg_bigint("sketch").alias("sketch"))

    return KeyedLog(spark, f"{folder}/log", ["source"], merge, **settings)


def stream_lateness(events: DataFrame, folder: str, source: Column, bound_seconds: int = 3600,
                    delay_seconds: int = 3600, trigger: dict | None = None, **settings) -> StreamingQuery:
    """How late each source's events come, and how many a watermark of ``delay_seconds`` would drop.

    A row is dropped that lies behind the newest time of earlier batches by more than the delay,
    late if it was sent more than ``bound_seconds`` after it happened, else on time; the three add
    up to all rows. :func:`watermark_delay` reads the delay to choose off the sketches.
    """
    lag = F.unix_millis("sent_at") - F.unix_millis("ts")

    def run(batch: DataFrame, n: int) -> None:
        log = lateness_log(batch.sparkSession, folder, **settings)
        if log.holds(n):
            return
        newest = log.read(LATENESS).agg(F.max("newest")).first()[0]
        mark = F.lit(newest).cast("timestamp") - F.make_interval(secs=F.lit(delay_seconds))
        dropped = F.coalesce(F.col("ts") < mark, F.lit(False))
        late = ~dropped & (lag > bound_seconds * 1000)
        log.add(batch.groupBy(source.alias("source")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~dropped & ~(lag > bound_seconds * 1000)).alias("on_time"),
            F.count_if(late).alias("late"), F.count_if(dropped).alias("dropped"), F.max("ts").alias("newest"),
            F.kll_sketch_agg_bigint(lag).alias("sketch")).select(*LATENESS.names), n)

    return _each(events.filter(F.col("ts").isNotNull() & F.col("sent_at").isNotNull()), folder, run, trigger)


def watermark_delay(log: DataFrame, share: float = 0.999) -> DataFrame:
    """``source, delay_seconds`` within which about that share of a source's events is sent."""
    at = F.kll_sketch_get_quantile_bigint("sketch", F.lit(share).cast("double"))
    return log.select("source", F.ceil(F.greatest(at, F.lit(0)) / F.lit(1000)).cast("long").alias("delay_seconds"))
