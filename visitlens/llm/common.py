"""What the text operators share: tables, text forms, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.session import new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of rows that Spark hands to Python at once; a longer row comes alone.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: Column | str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` does just that where all is ASCII and is much faster; other texts
    go through ``translate``, as ``lower`` would also change other letters.
    """
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the scan of
    all texts.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number per row, and that column's name, which no column of ``docs`` has.

    Decisions then are made on numbers, and the texts stay where they are.
    """
    name = "row_no"
    while name in docs.columns:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Numbered rows but for those whose numbers are in ``gone`` (column ``gone``), without the number.

    Each number is in ``gone`` once at most. A short list is sent to the rows by the adaptive planner.
    """
    left = rows.join(gone, rows[name] == gone["gone"], "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in rows.columns if c != name])


def mapped(df: DataFrame, batches: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, so that a task's memory does not follow the length
    of texts; callers take a batch apart by bytes or rows, as one row may hold a very long text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(batches, schema)


def by_bytes(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts take up to ``most`` bytes, or of one row that takes more."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls in a row, and where each begins and the last one ends."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, body = values.buffers()
    offsets = np.frombuffer(places, np.int64)[values.offset:values.offset + len(values) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def told_apart(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different ones of the parts of ``data`` that begin at ``starts``, and which one each part is."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    got = parts.dictionary_encode()
    return got.dictionary, got.indices.to_numpy()
