"""The stored event table: commits, batches that replace themselves, deletion by file.

A commit adds its events by day, its batch ids, which leads its files hold, and which
batches of earlier commits it holds again. Events of such earlier batches no longer count, so a batch
that is sent twice, in one commit or in two, is stored once. A commit that is run again
after a failure writes the same folders.

Within a day files are ranges of visitors, with Bloom filters on visitor and lead, so the history of one
visitor touches few row groups. A deleted lead costs the files that hold it, and days
past retention cost nothing: they leave the list.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.operators.periods import before
from visitlens.sources.parts import Part, PartTable

BATCHES = "batch_id string, events bigint, commit string"
LEAD_FILES = "lead_id string, event_date date, file string, commit string"
DAY = "event_date"
#: Columns whose values are looked for one by one.
LOOKED_FOR = ("visitor_id", "lead_id")


class EventStore:
    """Events under ``root``. With ``files_per_day`` a commit's day is dealt to so many ranges of visitors, where
    a hot visitor's events go on into the next range; without, each task writes the days it holds.
    ``keys_per_group``: different visitors and leads that a row group's Bloom filter is made for."""

    def __init__(self, spark: SparkSession, root: str, files_per_day: int | None = None,
                 keys_per_group: int = 100_000):
        self.table, self.files_per_day, self.keys_per_group = PartTable(spark, root), files_per_day, keys_per_group
        self.spark = spark

    def commits(self) -> list[str]:
        return [p.name.split("=")[1] for p in self.table.parts() if p.kind in ("events", "done")]

    def _written(self, events: DataFrame, commit: str) -> list[Part]:
        """The parts of a commit, written; of no events none."""
        name = f"commit={commit}"
        out = events.withColumn(DAY, F.to_date("ts"))
        if self.files_per_day:
            days = out.select(DAY).distinct().count()
            out = out.repartitionByRange(max(1, days * self.files_per_day), DAY, "visitor_id", "event_id")
        writer = (out.sortWithinPartitions(DAY, "visitor_id", "ts").write.partitionBy(DAY).mode("overwrite"))
        for c in LOOKED_FOR:
            writer = (writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                      .option(f"parquet.bloom.filter.expected.ndv#{c}", str(self.keys_per_group)))
        path = self.table.folder("events", name)
        writer.parquet(path)
        files = {d: None for d in self.table.values("events", name, DAY)}
        if not files:
            return []
        stored = self.spark.read.parquet(path)
        self.table.write(stored.groupBy("batch_id").agg(F.count(F.lit(1)).alias("events")), "batches", name)
        self.table.write(stored.filter("lead_id is not null").select(
            "lead_id", DAY, F.col("_metadata.file_name").alias("file")).distinct(), "lead_files", name)
        return [Part("events", name, {"schema": stored.schema.json(), "files": files}), Part("batches", name),
                Part("lead_files", name)]

    def add(self, events: DataFrame, commit: str) -> bool:
        """Store events (with ``batch_id`` and ``ts``) as one commit; False if it is stored already."""
        version, name = self.table.version(), f"commit={commit}"
        listed = self.table.parts(version=version)
        if any(p.name == name for p in listed):
            return False
        added = self._written(events, commit) or [Part("done", name)]
        earlier = [p for p in listed if p.kind == "batches"]
        if earlier and len(added) > 1:
            mine = self.table.read([Part("batches", name)], BATCHES).select("batch_id")
            again = self.table.read(earlier, BATCHES).join(mine, "batch_id", "left_semi")
            replaced = self.table.write(again.select("batch_id", F.col("commit").alias("of")), "replaced", name)
            # Only commits that replace something make readers look.
            if self.spark.read.parquet(replaced).limit(1).count():
                added.append(Part("replaced", name))
        self.table.publish(listed + added, version)
        return True

    def paths(self, keep=None, version: int | None = None) -> list[str]:
        """Folders and files of the table; ``keep(day)`` says which days are wanted."""
        out = []
        for p in self.table.parts("events", version):
            for day, names in p.facts["files"].items():
                if keep is None or keep(day):
                    folder = f"{self.table.folder('events', p.name)}/{DAY}={day}"
                    out += [folder] if names is None else [f"{folder}/{n}" for n in names]
        return out

    def _rows(self, paths: list[str], version: int) -> DataFrame:
        """Events that count among those of some paths."""
        schema = T.StructType.fromJson(json.loads(self.table.parts("events", version)[-1].facts["schema"]))
        schema = schema.add("commit", T.StringType()) if "commit" not in schema.names else schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.table.folder("events")).parquet(*paths)
        replaced = self.table.parts("replaced", version)
        if not replaced:
            return rows
        gone = self.table.read(replaced, "batch_id string, of string").select(
            "batch_id", F.col("of").alias("commit")).distinct()
        return rows.join(gone, ["batch_id", "commit"], "left_anti").select(*schema.names)

    def read(self, keep=None) -> DataFrame:
        """Events that count, with ``event_date`` to prune by and ``commit``."""
        version = self.table.version()
        if not self.table.parts("events", version):
            raise ValueError(f"{self.table.root} holds no events")
        return self._rows(self.paths(keep, version), version)

    def compact(self) -> str:
        """Write what counts as one commit that takes the place of all others."""
        version, commit = self.table.version(), f"all-{uuid.uuid4().hex[:12]}"
        # The names of the commits stay, so that none of them is stored a second time.
        old = [Part("done", p.name) for p in self.table.parts(version=version) if p.kind in ("events", "done")]
        self.table.publish(self._written(self.read().drop("commit"), commit) + old, version)
        return commit

    def delete_leads(self, leads: DataFrame, name: str) -> int:
        """Take out all events of some leads (``lead_id``); only files that hold one are written anew.

        Returns how many files that were. A deletion of a name that was done before does nothing.
        """
        version, commit = self.table.version(), f"commit=without-{name}"
        listed = self.table.parts(version=version)
        if any(p.name == commit for p in listed):
            return 0
        gone = leads.select("lead_id").filter(F.col("lead_id").isNotNull()).distinct()
        index = self.table.read([p for p in listed if p.kind == "lead_files"], LEAD_FILES)
        # A row per file of the table at most, and files are listed by name anyway.
        found = (index.join(gone, "lead_id", "left_semi").select("commit", F.col(DAY).cast("string").alias(DAY), "file")
                 .distinct().collect())
        hit: dict[tuple[str, str], set[str]] = {}
        for r in found:
            hit.setdefault((f"commit={r['commit']}", r[DAY]), set()).add(r["file"])
        parts, paths = [], []
        for p in listed:
            if p.kind != "events":
                parts.append(p)
                continue
            files = {}
            for day, names in p.facts["files"].items():
                folder = f"{self.table.folder('events', p.name)}/{DAY}={day}"
                held = hit.get((p.name, day), set()) & set(self._files(folder) if names is None else names)
                paths += [f"{folder}/{n}" for n in sorted(held)]
                left = names if not held else [n for n in (self._files(folder) if names is None else names) if n not in held]
                if left is None or left:
                    files[day] = left
            parts.append(Part("events", p.name, {**p.facts, "files": files}) if files else Part("done", p.name))
        rows = self._rows(paths, version).join(gone, "lead_id", "left_anti") if paths else None
        written = self._written(rows.drop("commit"), commit.split("=")[1]) if paths else []
        self.table.publish(parts + (written or [Part("done", commit)]), version)
        return len(paths)

    def drop_days_before(self, as_of, days: int = 730) -> list[str]:
        """Days past retention leave the table; returns them. No file is read or written."""
        oldest = str(self.spark.range(1).select(F.to_date(before(as_of, days=days))).first()[0])
        version, out, gone = self.table.version(), [], set()
        for p in self.table.parts(version=version):
            if p.kind == "events":
                files = {d: n for d, n in p.facts["files"].items() if d >= oldest}
                gone |= set(p.facts["files"]) - set(files)
                out.append(Part("events", p.name, {**p.facts, "files": files}) if files else Part("done", p.name))
            else:
                out.append(p)
        if gone:
            self.table.publish(out, version)
        return sorted(gone)

    def _files(self, folder: str) -> list[str]:
        return sorted(n for n in self.table.file_names(folder) if n.endswith(".parquet"))
