"""Tables of Parquet parts, switched by a numbered list.

``<root>/parts/<kind>/<name>`` folders are written whole and never changed once listed.
``<root>/lists/<n>`` names the parts of version n. A list appears by one rename, so a
reader sees the parts of the version before or after, and what a lost driver left half
done is named by no list and written anew. There is one writer per table at a time;
a second one finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Part:
    """``kind`` and ``name`` give the folder; ``facts``: what a reader may know without opening it."""

    kind: str
    name: str
    facts: dict = field(default_factory=dict, hash=False)


class PartTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, kind: str, name: str = "") -> str:
        return f"{self.root}/parts/{kind}/{name}".rstrip("/")

    def version(self) -> int:
        """Number of the newest list, 0 before the first."""
        lists = self._path(f"{self.root}/lists")
        if not self._fs.exists(lists):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(lists)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def parts(self, kind: str | None = None, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path(f"{self.root}/lists/{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [p for p in (Part(**x) for x in json.loads(text)) if kind in (None, p.kind)]

    def publish(self, parts: list[Part], before: int) -> int:
        """Make ``parts`` the table, if the newest list still is number ``before``."""
        target = self._path(f"{self.root}/lists/{before + 1}")
        draft = self._path(f"{self.root}/lists/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps([asdict(p) for p in parts]), "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.root}: version {before + 1} was written by someone else")
        return before + 1

    def write(self, df: DataFrame, kind: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
        """Write a part, over what an earlier try left. It counts once a list names it."""
        path = self.folder(kind, name)
        df.write.partitionBy(*partition_by).mode("overwrite").parquet(path)
        return path

    def values(self, kind: str, name: str, column: str) -> list[str]:
        """Values of the column that a part is partitioned by."""
        folders = self._fs.listStatus(self._path(self.folder(kind, name)))
        names = [s.getPath().getName() for s in folders if s.isDirectory()]
        return sorted(n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}="))

    def file_names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def replace(self, df: DataFrame, kind: str, name: str, column: str, values: list[str],
                add: list[Part] = (), without: str | None = None) -> int:
        """Publish ``df`` as what the table holds for some values of ``column``.

        Other values stay in the parts that hold them, which are not touched. ``add``: further parts of
        this version; ``without``: a kind of which the new version has no parts.
        """
        version = self.version()
        self.write(df, kind, f"part={name}", (column,))
        written = self.values(kind, f"part={name}", column)
        gone, out = {*map(str, values), *written}, []
        for p in self.parts(version=version):
            if p.kind == kind:
                left = [v for v in p.facts["values"] if v not in gone]
                out += [Part(kind, p.name, {**p.facts, "values": left})] if left else []
            elif p.kind != without:
                out.append(p)
        if written:
            out.append(Part(kind, f"part={name}", {"values": written}))
        return self.publish(out + list(add), version)

    def live(self, kind: str, schema, column: str, keep=None, version: int | None = None) -> DataFrame:
        """What the table holds by :meth:`replace`; ``keep(value)`` says which values are read at all."""
        paths = [f"{self.folder(kind, p.name)}/{column}={v}" for p in self.parts(kind, version)
                 for v in p.facts["values"] if keep is None or keep(v)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", self.folder(kind)).parquet(*paths)
                .drop("part"))

    def read(self, parts: list[Part], schema) -> DataFrame:
        """The rows of some parts of one kind; without parts, none.

        ``schema`` includes the columns that parts are partitioned by.
        """
        if not parts:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", self.folder(parts[0].kind))
                .parquet(*[self.folder(p.kind, p.name) for p in parts]))

    def drop_unlisted(self, keep_versions: int = 2) -> list[str]:
        """Delete parts that none of the newest lists names, and older lists. No job may be writing."""
        newest = self.version()
        kept = {self.folder(p.kind, p.name) for v in range(max(1, newest - keep_versions + 1), newest + 1)
                for p in self.parts(version=v)}
        gone = []
        top = self._path(f"{self.root}/parts")
        for kind in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for part in self._fs.listStatus(kind.getPath()):
                path = self.folder(kind.getPath().getName(), part.getPath().getName())
                if path not in kept:
                    self._fs.delete(part.getPath(), True)
                    gone.append(path)
        for v in range(1, newest - keep_versions + 1):
            self._fs.delete(self._path(f"{self.root}/lists/{v}"), False)
        return gone
