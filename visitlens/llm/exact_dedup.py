"""Exact dedup against a persistent index of digests.

The index is a table of text digests, bucketed and sorted by digest, at a path
that all executors share. A batch of documents is reduced to digests, those are
grouped, a sort-merge anti-join finds the digests the index lacks, and these are
appended. Texts never shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import ascii_lower, numbered, staged, whole, without


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed digest table at ``path``; made when absent, reopened when present.

    ``buckets`` belongs to the table: give the same number each time.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    @property
    def name(self) -> str:
        """Two paths never share a name, however alike they end."""
        return "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'")
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(f"`{self.name}`")

    def append(self, fresh: DataFrame) -> None:
        """One file per bucket and append; a failed append leaves nothing."""
        (fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write
         .bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
         .saveAsTable(f"`{self.name}`", path=self.path))


def digests(docs: DataFrame, number: str | None = None) -> DataFrame:
    """``doc_id``, SHA-256 ``digest`` of the text with A-Z in lower case, and a row number (the column ``number``)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.sha2(ascii_lower(whole()).cast("binary"), 256)).alias("digest"),
                       (F.col(number) if number else F.monotonically_increasing_id()).alias("row_no"))


def ingest(docs: DataFrame, index: DigestIndex, batch: str = "0") -> DataFrame:
    """Decide on each row of a batch and add its new digests to the index.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row
    of ``docs``. Of equal texts in a batch the largest ``doc_id`` stays, exactly
    one row of it when the row itself is repeated; if all ids are null, any one
    row stays. A text the index knows from another batch is dropped in favour of
    the ``keep_id`` found there. ``group_size`` counts the rows of this batch.
    A null text is an empty text. An empty table gives no rows. Only ``doc_id``
    and ``text`` are read, so other columns never clash.

    Running a batch again, say after a lost driver, gives the same decisions:
    rows of the same ``batch`` in the index don't count as known.

    A text shared by a third of all rows costs one row per task in the grouping
    (combined before the shuffle). The join back to rows carries only ids and
    digests; its hot key is split by the adaptive skew join.
    """
    return _decided(digests(docs), index, batch).drop("row_no")


def _decided(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``ingest`` of digests, with the rows' numbers."""
    index.open()
    rows = staged(rows, "digests")
    groups = staged(rows.groupBy("digest").agg(
        F.max("doc_id").alias("own_id"), F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.max_by("row_no", "doc_id"), F.max("row_no")).alias("keep_row")), "digest-groups")
    missing = groups.hint("merge").join(index.rows(), "digest", "left_anti")
    index.append(missing.select("digest", F.col("own_id").alias("keep_id"), F.lit(batch).alias("batch")))
    known = index.rows().filter(F.col("batch") != batch).select(
        "digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    decided = groups.hint("merge").join(known, "digest", "left").select(
        "digest", "group_size", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("own_id")).alias("keep_id"),
        F.when(F.col("old"), F.lit(None)).otherwise(F.col("keep_row")).alias("keep_row"))
    # Texts that occur once need no look-up; the left join passes them by.
    shared = decided.filter((F.col("group_size") > 1) | F.col("keep_row").isNull()).withColumn("_found", F.lit(True))
    return rows.join(shared, "digest", "left").select(
        "row_no", "doc_id",
        F.when(F.col("_found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(F.col("_found"), F.coalesce(F.col("keep_row") == F.col("row_no"), F.lit(False)))
        .otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str = "0") -> DataFrame:
    """``docs`` without the rows that ``ingest`` drops; all columns stay as they are."""
    rows, number = numbered(docs)
    gone = _decided(digests(rows, number), index, batch).filter(~F.col("kept")).select(F.col("row_no").alias("gone"))
    return without(rows, number, gone)
