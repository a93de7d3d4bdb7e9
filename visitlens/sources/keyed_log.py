"""Mergeable rows by key: a snapshot in buckets and a short tail of batches.

A batch is added as one small part of its own. Every ``fold_every`` batches the tail is
merged into the snapshot, of which only the buckets with keys of the tail are written anew.
A new version appears at once, so a lost driver leaves the version before. A
reader that knows its keys reads their buckets and the tail, however long the log runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.sources.parts import Part, PartTable

BUCKET = "_bucket"


class KeyedLog:
    """``merge`` makes one row (or a few) per key out of rows of any batches, and may be applied again to its own
    result. ``buckets`` may be chosen when the log is made and not later."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = 64, fold_every: int = 8):
        self.spark, self.table, self.keys, self.merge = spark, PartTable(spark, root), keys, merge
        self.buckets, self.fold_every = buckets, fold_every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def holds(self, number: int) -> bool:
        """Whether the batch of that number, or a later one, was added."""
        return any(p.kind == "upto" and int(p.name) >= number for p in self.table.parts())

    def add(self, rows: DataFrame, number: int, outcome: DataFrame | None = None) -> bool:
        """Add batch ``number``, and ``outcome`` with it; False if it was added before.

        Numbers rise from batch to batch. Outcomes of batches that were added are read by :meth:`outcomes`;
        a batch that is lost on the way and done again writes over its own.
        """
        if self.holds(number):
            return False
        version = self.table.version()
        listed = [p for p in self.table.parts(version=version) if p.kind != "upto"]
        name = f"batch={number}"
        self.table.write(rows, "tail", name)
        added = [Part("tail", name, {"schema": rows.schema.json()}), Part("upto", str(number))]
        if outcome is not None:
            outcome.write.mode("overwrite").parquet(f"{self.table.root}/outcome/{name}")
        self.table.publish(listed + added, version)
        if sum(p.kind == "tail" for p in listed) + 1 >= self.fold_every:
            self.fold()
        return True

    def _schema(self, version: int) -> T.StructType | None:
        parts = [p for p in self.table.parts(version=version) if p.kind in ("tail", "snapshot")]
        for p in parts:
            if "schema" in p.facts:
                return T.StructType.fromJson(json.loads(p.facts["schema"]))
        if not parts:
            return None
        held = self.spark.read.parquet(self.table.folder("snapshot", parts[0].name)).schema
        return T.StructType([f for f in held.fields if f.name != BUCKET])

    def _rows(self, version: int, buckets: list[int] | None) -> tuple[DataFrame, T.StructType]:
        schema = self._schema(version)
        keep = None if buckets is None else set(map(str, buckets)).__contains__
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        snapshot = self.table.live("snapshot", stored, BUCKET, keep, version).drop(BUCKET)
        tail = self.table.parts("tail", version)
        if not tail:
            return snapshot, schema
        return snapshot.unionByName(self.table.read(tail, schema).select(*schema.names)), schema

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """Merged rows of all keys; an empty log needs a schema to give none."""
        version = self.table.version()
        if self._schema(version) is None:
            if schema is None:
                raise ValueError(f"{self.table.root} holds no rows")
            return self.spark.createDataFrame([], schema)
        return self.merge(self._rows(version, None)[0])

    def read_for(self, keys: DataFrame, schema: T.StructType) -> DataFrame:
        """Merged rows of some keys: their buckets of the snapshot, and the tail."""
        version = self.table.version()
        if self._schema(version) is None:
            return self.spark.createDataFrame([], schema)
        wanted = keys.select(*self.keys).distinct()
        touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        rows, _ = self._rows(version, touched)
        return self.merge(rows.join(wanted, self.keys, "left_semi"))

    def outcomes(self, schema: T.StructType) -> DataFrame:
        """Outcomes of all batches that were added, with ``batch``."""
        upto = max((int(p.name) for p in self.table.parts("upto")), default=-1)
        stored = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
        if upto < 0:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(f"{self.table.root}/outcome").filter(F.col("batch") <= upto)

    def fold(self) -> None:
        """Merge the tail into the snapshot."""
        version = self.table.version()
        tail = self.table.parts("tail", version)
        if not tail:
            return
        schema = self._schema(version)
        touched = [r[0] for r in self.table.read(tail, schema).select(self._bucket()).distinct().collect()]
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        old = self.table.live("snapshot", stored, BUCKET, set(map(str, touched)).__contains__, version).drop(BUCKET)
        merged = self.merge(old.unionByName(self.table.read(tail, schema).select(*schema.names)))
        # A bucket's rows lie together, so that each is one file.
        out = merged.select(*schema.names, self._bucket()).repartition(BUCKET)
        self.table.replace(out, "snapshot", f"fold-{version}", BUCKET, touched, without="tail")
