"""Session and profile tables that take in batches of events by merging states.

Sessions are kept as mergeable states by the day they end on. A batch is cut into
sessions by itself; only stored sessions of its visitors that lie within the gap of the
batch's can grow, be joined or be bridged, and only the days that hold these are
written anew. Activity per visitor and session needs no order, so it goes through a
:class:`KeyedLog`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.operators import profiles, sessions
from visitlens.operators.skew import HOT_ROWS, RunningSum, along, heavy_keys, lookup
from visitlens.session import new_folder
from visitlens.sources.keyed_log import KeyedLog
from visitlens.sources.parts import Part, PartTable

KIND, DAY = "sessions", "end_date"


class SessionTable:
    """Sessions of ``key`` cut after ``gap_seconds`` idle, kept under ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "visitor_id",
                 gap_seconds: int = sessions.GAP_SECONDS, hot_rows: int = HOT_ROWS):
        self.spark, self.table = spark, PartTable(spark, root)
        self.key, self.gap, self.hot_rows = key, gap_seconds, hot_rows

    def merge(self, events: DataFrame, name: str) -> bool:
        """Take in a batch of events; False if one of that name was taken in before."""
        version = self.table.version()
        listed = self.table.parts(version=version)
        if any(p.kind == "done" and p.name == name for p in listed):
            return False
        key, gap = self.key, F.lit(self.gap * 1_000_000)
        fresh_at = new_folder(self.spark, "fresh-sessions")
        cut = sessions.sessionize(events, self.gap, key, self.hot_rows)
        fresh = (sessions.session_state(cut, [key, "session_number"]).drop("session_number")
                 .withColumn(DAY, F.to_date("end_time")))
        fresh.write.parquet(fresh_at)
        schema = fresh.schema
        fresh = self.spark.read.schema(schema).parquet(fresh_at)
        reach = fresh.groupBy(key).agg(
            F.timestamp_micros(F.min(F.unix_micros("start_time")) - gap).alias("_from"),
            F.timestamp_micros(F.max(F.unix_micros("end_time")) + gap).alias("_upto"))
        earliest = reach.agg(F.to_date(F.min("_from"))).first()[0]
        done = Part("done", name)
        if earliest is None:
            self.table.publish([*listed, done], version)
            return True
        schema = T.StructType([*schema.fields])
        old = self.table.live(KIND, schema, DAY, lambda day: day >= str(earliest), version)
        near_at = new_folder(self.spark, "near-sessions")
        # Visitors of the batch are few rows against their stored sessions; a hot one's are spread.
        inside = (F.col("end_time") >= F.col("_from")) & (F.col("start_time") <= F.col("_upto"))
        marked = lookup(old, reach, key, "start_time", hot_rows=self.hot_rows)
        marked.withColumn("_near", F.coalesce(inside, F.lit(False))).drop("_from", "_upto").write.parquet(near_at)
        marked = self.spark.read.parquet(near_at)
        days = (marked.filter("_near").select(DAY).union(fresh.select(DAY))).distinct()
        touched = [str(r[0]) for r in days.collect()]
        whole = sessions.joined_session_states(
            marked.filter("_near").drop("_near").unionByName(fresh).drop(DAY), key, self.gap, self.hot_rows)
        kept = marked.filter(~F.col("_near") & F.col(DAY).cast("string").isin(touched)).drop("_near")
        out = whole.withColumn(DAY, F.to_date("end_time")).unionByName(kept)
        self.table.replace(out, KIND, name, DAY, touched, [done])
        return True

    def states(self) -> DataFrame:
        version = self.table.version()
        part = next((p for p in self.table.parts(KIND, version)), None)
        if part is None:
            raise ValueError(f"{self.table.root} holds no sessions")
        schema = self.spark.read.parquet(self.table.folder(KIND, part.name)).schema
        return self.table.live(KIND, schema, DAY, version=version)

    def read(self) -> DataFrame:
        """Session rows as :func:`sessions.session_rollup` gives them, numbered per visitor."""
        states = self.states().drop(DAY).withColumn("_id", F.col("first.event_id"))
        hot = heavy_keys(states, [self.key], self.hot_rows)
        numbered = along(states, [self.key], ["start_time", "_id"], {"session_number": RunningSum(F.lit(1))}, hot)
        numbered = numbered.withColumn("session_number", F.col("session_number").cast("long"))
        return sessions.finished_sessions(numbered, [self.key, "session_number"])


def activity_log(spark: SparkSession, root: str, key: str = "visitor_id", **settings) -> KeyedLog:
    """Activity per visitor and session as a log of states; ``profiles.activity_of(log.read())`` gives totals."""
    return KeyedLog(spark, root, [key], lambda rows: profiles.merge_activity_states(rows, key), **settings)
