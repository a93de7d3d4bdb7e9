"""Snapshots that are read page by page.

A snapshot is written in reading order over ranges, so a page's start, pushed down as a
filter, skips the row groups before it, and a page costs its own rows. A cursor names the
snapshot's version and the last row read: new versions don't move what a reader goes on to see.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.sources.parts import Part, PartTable


@dataclass(frozen=True)
class Cursor:
    """``last``: the newest-first column and the tie-breaking column of the last row; None before the first page."""

    version: int
    last: tuple | None = None


class PagedSnapshot:
    """Rows under ``root``, newest first by ``newest``, ties by ``tie`` (which is unique and not null)."""

    def __init__(self, spark: SparkSession, root: str, newest: str = "updated_at", tie: str = "lead_id"):
        self.spark, self.table, self.newest, self.tie = spark, PartTable(spark, root), newest, tie

    def _order(self) -> list[Column]:
        return [F.col(self.newest).desc_nulls_last(), F.col(self.tie).asc()]

    def write(self, rows: DataFrame, files: int | None = None) -> Cursor:
        """Make ``rows`` the newest version; versions before stay readable until they are cleaned up."""
        version, name = self.table.version(), uuid.uuid4().hex[:12]
        ranged = rows.repartitionByRange(files, *self._order()) if files else rows.repartitionByRange(*self._order())
        self.table.write(ranged.sortWithinPartitions(*self._order()), "rows", name)
        return Cursor(self.table.publish([Part("rows", name, {"schema": rows.schema.json()})], version))

    def first(self) -> Cursor:
        """Start of the newest version."""
        return Cursor(self.table.version())

    def rows(self, cursor: Cursor) -> DataFrame:
        part, = self.table.parts("rows", cursor.version)
        return self.table.read([part], T.StructType.fromJson(json.loads(part.facts["schema"])))

    def page(self, cursor: Cursor, limit: int) -> DataFrame:
        """The next ``limit`` rows behind the cursor, in order."""
        rows = self.rows(cursor)
        if cursor.last is not None:
            newest, tie = cursor.last
            behind = F.col(self.tie) > F.lit(tie)
            if newest is None:
                rows = rows.filter(F.col(self.newest).isNull() & behind)
            else:
                at = F.col(self.newest)
                rows = rows.filter(at.isNull() | ((at <= F.lit(newest)) & ((at < F.lit(newest)) | behind)))
        return rows.orderBy(*self._order()).limit(limit)

    def after(self, cursor: Cursor, page: DataFrame) -> Cursor | None:
        """Cursor behind a page, None behind the last one."""
        last = page.select(self.newest, self.tie).tail(1)
        return Cursor(cursor.version, tuple(last[0])) if last else None
