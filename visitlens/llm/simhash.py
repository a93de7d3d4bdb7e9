"""SimHash near-dedup by a grid range-join over segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The vector of the
segments' bit counts (0 to 2 each) embeds the fingerprint in a grid: flipping one
bit moves one count by one, so the Manhattan distance of two vectors is at most
the number of differing bits. Each count is written as a thermometer (00, 01,
11), which makes that distance the bit count of an XOR.

Range-join: cut the 32 axes into ``k // 2 + 1`` parts for a limit of k bits.
Two vectors within k of each other differ by at most 1 on some part. So each
vector goes to its own unit cell on each part, and to the cells one step away;
a pair meets where one's own cell is a cell the other reaches. Pairs that meet
are held to the Manhattan bound on all axes, then to the exact bit distance. For
k = 3 that is 2 own cells and about 50 reached ones per different fingerprint.

Tables with a row per fingerprint, cell or document are merged, never broadcast:
Spark sizes them by their packed files and does not count the rows an explode makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import mapped, numbered, staged, whole, without
from visitlens.llm.components import components

SEED = 42
SEGMENTS = 32
_LOW = 0x5555555555555555
_STEP = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the shingles of one text, as an unsigned number; no words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1:] - 1).tolist()
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        some = np.array([digest(joined[a:b], SEED) for a, b in
                         zip(starts[at:at + _STEP], stops[at:at + _STEP], strict=True)], np.uint64)
        set_in += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, number: str | None = None) -> DataFrame:
    """``row_no, doc_id, fp``: the fingerprint of each row as a signed 64-bit number, beside the column ``number``."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))],
                                             ["row_no", "doc_id", "fp"])

    row = F.col(number) if number else F.lit(0).cast("bigint")
    return mapped(docs.select(row.alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"),
                              whole().cast("binary").alias("text")), batches, "row_no bigint, doc_id bigint, fp bigint")


def thermometer(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, 00, 01 or 11 in the place of each."""
    low, next_ = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(next_).bitwiseAND(low)
            .bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(low), 1)))


def _parts(k: int) -> list[range]:
    n = k // 2 + 1
    cuts = [SEGMENTS * i // n for i in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cells(part: int, axes: range, near: bool) -> list[Column]:
    """Own cell on a part; with ``near`` those one step along an axis as well.

    A cell is the part's number and its counts, mixed into one key. Equal keys
    of different cells only cost a candidate, which the checks then drop.
    """
    mask = sum(3 << 2 * i for i in axes)
    signed = mask - (1 << 64) if mask >> 63 else mask
    own = F.col("grid").bitwiseAND(F.lit(signed))
    key = lambda cell: F.xxhash64(F.lit(part), cell)
    out = [key(own)]
    for i in axes if near else ():
        low, high = 1 << 2 * i, 2 << 2 * i
        high = high - (1 << 64) if high >> 63 else high
        has_low, has_high = own.bitwiseAND(F.lit(low)) != 0, own.bitwiseAND(F.lit(high)) != 0
        out.append(F.when(~has_high, key(own.bitwiseXOR(F.lit(low)))))
        out.append(F.when(has_low, key(own.bitwiseXOR(F.lit(high)))))
    return out


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``a, b`` of the different fingerprints in ``prints`` (``fp``, no repeats) within the limit."""
    points = prints.select("fp", thermometer(F.col("fp")).alias("grid"))
    parts = list(enumerate(_parts(max_bits)))
    home = points.select("fp", "grid", F.explode(F.array(
        *[c for p, axes in parts for c in _cells(p, axes, near=False)])).alias("cell"))
    reach = points.select(F.col("fp").alias("other"), F.explode(F.array_compact(F.array(
        *[c for p, axes in parts for c in _cells(p, axes, near=True)]))).alias("cell"))
    met = home.hint("merge").join(reach, "cell").filter(F.col("fp") < F.col("other"))
    bound = F.bit_count(F.col("grid").bitwiseXOR(thermometer(F.col("other")))) <= max_bits
    exact = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    return met.filter(bound & exact).select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Rows link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the least ``doc_id`` that links reach (null when all ids of
    the group are null). Only ``doc_id`` and ``text`` are read. A null or wordless
    text has fingerprint zero and links like any other. An empty table gives no
    rows; repeated rows give repeated results.

    Equal fingerprints are merged before any join, so a group of copies is one
    point; near copies are joined by cells only, and links are never all pairs of
    a group of documents. A hot fingerprint meets its group in an adaptive skew
    join of two numbers per row.
    """
    rows = staged(fingerprints(docs, words).drop("row_no"), "fingerprints")
    classes = _classes(rows, max_bits)
    return rows.hint("merge").join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component_id`` of each different fingerprint; ``root`` names the group, also where it has no id."""
    points = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "points")
    roots = staged(components(links(points.select("fp"), max_bits)), "roots")
    members = roots.hint("merge").join(points, roots["node"] == points["fp"])
    least = members.groupBy("root").agg(F.min("least_id").alias("group_id"))
    grouped = roots.hint("merge").join(least, "root").select(F.col("node").alias("fp"), "root", "group_id")
    return points.hint("merge").join(grouped, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("group_id")).otherwise(F.col("least_id")).alias("component_id"))


def drop_near(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each group, the one with the least id; columns unchanged.

    Null ids come after all others. Of rows that share the least id the first written stays.
    """
    rows, number = numbered(docs)
    prints = staged(fingerprints(rows, words, number), "fingerprints")
    classes = _classes(prints, max_bits).select("fp", "root")
    grouped = staged(prints.hint("merge").join(classes, "fp").select("root", "row_no", "doc_id"), "near-groups")
    # The numbers that stay are combined before they move; a hot group is one row per task.
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("m"))
    gone = grouped.hint("merge").join(stay.select("root", F.col("m.row_no").alias("first")), "root").filter(
        "row_no <> first").select(F.col("row_no").alias("gone"))
    return without(rows, number, gone)
