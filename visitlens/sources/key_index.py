"""Index of event keys, to find copies of events across batches and days.

A copy has the time of its original, so keys are kept by day of the event. In front of each
day's keys stands a Bloom filter in words of 64 bits (all bits of a key lie in one word), which
is a table too: a batch meets the filters of its days in a join of two small columns. Only keys
that a filter lets through are looked up in the index, exactly, and the event table is
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators import sessions
from visitlens.session import new_folder
from visitlens.sources.parts import Part, PartTable

KEY = ["visitor_id", "session_id", "raw_type", "ts", "url"]
DAY = "key_day"
KEYS = f"key binary, {DAY} date"
FILTER = f"word bigint, bits bigint, {DAY} date"
BITS_PER_KEY = 4


class KeyIndex:
    """Keys under ``root``. ``words``: 64-bit words of each day's filter; about a fourth of a day's events
    keeps false hits near one in a hundred. They cost a lookup and change no result."""

    def __init__(self, spark: SparkSession, root: str, words: int = 1 << 20):
        self.spark, self.table, self.words = spark, PartTable(spark, root), words

    def _keyed(self, events: DataFrame) -> DataFrame:
        """``events`` with the hash of the key, its day, its word of the filter and its bits there."""
        parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("")) for c in [*KEY[:3], "url", "data"]]
        key = F.unhex(F.sha2(F.concat_ws("|", F.unix_micros("ts").cast("string"), *parts), 256))
        out = events.withColumn("key", key).withColumn(DAY, F.to_date("ts")).withColumn("_h", F.xxhash64("key"))

        def bit(i: int) -> Column:
            return F.shiftright("_h", 6 * i).bitwiseAND(F.lit(63)).cast("int")

        bits = F.expr("0L")
        for i in range(BITS_PER_KEY):
            out = out.withColumn(f"_b{i}", bit(i))
            bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, _b{i})"))
        word = F.pmod(F.shiftrightunsigned("_h", 6 * BITS_PER_KEY), F.lit(self.words))
        return out.withColumns({"bits": bits, "word": word}).drop("_h", *(f"_b{i}" for i in range(BITS_PER_KEY)))

    def holds(self, name: str) -> bool:
        return any(p.kind == "done" and p.name == name for p in self.table.parts())

    def fresh(self, events: DataFrame) -> DataFrame:
        """Events that are no copies, of each other or of any added before; see :func:`sessions.dedupe_events`."""
        return self._fresh(events).drop("key", DAY, "bits", "word")

    def _fresh(self, events: DataFrame) -> DataFrame:
        one = self._keyed(sessions.dedupe_events(events))
        at = new_folder(self.spark, "batch-events")
        one.write.parquet(at)
        one = self.spark.read.parquet(at)
        version = self.table.version()
        days = {str(r[0]) for r in one.select(DAY).distinct().collect()}
        filters = self.table.live("filter", FILTER, DAY, days.__contains__, version)
        hits = (one.select("key", DAY, "word", "bits").join(filters.withColumnRenamed("bits", "held"), [DAY, "word"])
                .filter(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits")).select("key", DAY))
        maybe_at = new_folder(self.spark, "maybe-copies")
        hits.write.parquet(maybe_at)
        hits = self.spark.read.schema(KEYS).parquet(maybe_at)
        # Days of which no key passed the filter need no look at their keys.
        days = {str(r[0]) for r in hits.select(DAY).distinct().collect()}
        known = hits.join(self.table.live("keys", KEYS, DAY, days.__contains__, version), ["key", DAY], "left_semi")
        return one.join(known, ["key", DAY], "left_anti") if days else one

    def add(self, events: DataFrame, name: str) -> DataFrame:
        """The fresh events of a batch, written, whose keys the index now holds.

        A batch of a name that was added before gives what it gave then.
        """
        path = self.table.folder("fresh", name)
        if not self.holds(name):
            version = self.table.version()
            self._fresh(events).write.mode("overwrite").parquet(path)
            new = self.spark.read.parquet(path)
            self.table.write(new.select("key", DAY), "keys", f"part={name}", (DAY,))
            days = self.table.values("keys", f"part={name}", DAY)
            old = self.table.live("filter", FILTER, DAY, set(days).__contains__, version)
            merged = (old.unionByName(new.select("word", "bits", DAY)).groupBy(DAY, "word")
                      .agg(F.bit_or("bits").alias("bits")))
            add = [Part("done", name)] + ([Part("keys", f"part={name}", {"values": days})] if days else [])
            self.table.replace(merged, "filter", name, DAY, days, add)
        return self.spark.read.parquet(path).drop("key", DAY, "bits", "word")
