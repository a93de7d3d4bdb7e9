"""Benchmark decontamination by a broadcast set of normalised n-gram windows.

Texts and benchmark items are brought to one form: words, lower case in A-Z, one
separator behind each word. A window of words is then a run of bytes. Its hash is
the difference of two entries of a running polynomial sum, so all windows of a batch
are hashed at once, and a bitmap over the hashes of the benchmark's windows leaves few
to look up. Every hit is verified byte by byte.

The window set is broadcast only after its size was measured. Beyond
``Settings.most_bytes`` only a bitmap of fixed size is sent, the windows that it
lets through are written, and they meet the benchmark's windows in a join.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import mapped, staged, whole

LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SEPARATOR = 0x20
#: Any odd number with well spread bits; odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Settings:
    """``words`` of a window. ``most_bytes``: the window set that may be broadcast.
    ``bitmap_bits``: size (as a power of two) of the bitmap in front of the lookup.
    ``piece``: bytes of normalised text hashed at once."""

    words: int = 10
    most_bytes: int = 64 << 20
    bitmap_bits: int = 24
    piece: int = 1 << 20


class Words:
    """Words of some texts: places in the texts and in their normalised form."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        """``raw``: the texts' bytes with a byte that is no letter behind each; ``ends``: behind each text."""
        letter = np.concatenate([[False], LETTER[raw], [False]])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.text_of = np.searchsorted(ends, self.start, "right")
        size = self.end - self.start + 1
        self.upto = np.cumsum(size)
        self.at = self.upto - size
        # A word is followed by at least one byte of another kind; the first of them becomes the separator.
        take = letter[1:-1].copy()
        take[self.end[self.end < len(raw)]] = True
        self.plain = LOWER[raw[take]]
        self.plain[self.upto - 1] = SEPARATOR

    def __len__(self) -> int:
        return len(self.start)

    def window(self, i: int, words: int) -> bytes:
        return self.plain[self.at[i]:self.upto[i + words - 1]].tobytes()


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = []
        for factor in (BASE, INVERSE):
            out = np.empty(size, np.uint64)
            out[0], have = 1, 1
            while have < size:
                more = min(have, size - have)
                out[have:have + more] = out[:more] * np.uint64(pow(factor, have, 1 << 64))
                have += more
            _POWERS.append(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def spread(hashes: np.ndarray) -> np.ndarray:
    """The low bits of a polynomial hash depend on few letters; mix all of them."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def pieces(some: Words, words: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts, whose windows together hold about ``most`` bytes."""
    first, last = 0, len(some) - words + 1
    while first < last:
        upto = int(np.searchsorted(some.upto, some.at[first] + most, "right")) - words + 1
        upto = min(max(upto, first + 1), last)
        yield first, upto
        first = upto


def hashes(some: Words, words: int, first: int, upto: int) -> np.ndarray:
    """Hash of each window that starts at word first, .., upto - 1."""
    begin, end = some.at[first], some.upto[upto + words - 2]
    power, inverse = _powers(int(end - begin) + 1)
    total = np.zeros(int(end - begin) + 1, np.uint64)
    np.cumsum((some.plain[begin:end].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    start = some.at[first:upto] - begin
    stop = some.upto[first + words - 1:upto + words - 1] - begin
    return spread((total[stop] - total[start]) * inverse[start])


@dataclass
class WindowSet:
    """Sorted hashes of the benchmark's windows, their bytes, and the items each occurs in."""

    bits: int
    lengths: list[int]
    bitmap: np.ndarray
    hash: np.ndarray
    window: list[bytes]
    items: list[list[str]]

    def maybe(self, values: np.ndarray) -> np.ndarray:
        return self.bitmap[values >> np.uint64(64 - self.bits)]

    def find(self, value: int, window: bytes) -> int:
        """Number of the window, -1 if it isn't one; equal hashes are told apart by their bytes."""
        i = int(np.searchsorted(self.hash, value))
        while i < len(self.hash) and self.hash[i] == value:
            if self.window[i] == window:
                return i
            i += 1
        return -1


def texts_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, row behind the last, their bytes, ends."""
    first = 0
    while first < batch.num_rows:
        upto, size, out = first, 0, []
        while upto < batch.num_rows and (upto == first or size < most):
            out.append(batch.column(column)[upto].as_buffer() or b"")
            size += len(out[-1])
            upto += 1
        raw = np.frombuffer(b"\n".join(out) + b"\n", np.uint8)
        yield first, upto, raw, np.cumsum([len(x) + 1 for x in out])
        first = upto


def benchmark_windows(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``words, hash, window, item_id``: each different window of each item.

    ``words`` is the window's number of words: ``settings.words``, or all words of an
    item that has fewer. Items without words have no window; a null id counts as
    empty text; a repeated item adds nothing.
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for first, _, raw, ends in texts_of(b, 1):
                words = Words(raw, ends)
                cuts = np.searchsorted(words.text_of, np.arange(len(ends) + 1)).tolist()
                out = []
                for i, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    n = min(settings.words, q - p)
                    if n:
                        item = b.column(0)[first + i].as_py()
                        found = {words.window(k, n): k for k in range(p, q - n + 1)}
                        values = {k: int(hashes(words, n, k, k + 1)[0]) for k in found.values()}
                        out += [(n, values[k] - (1 << 64) * (values[k] >> 63), w, item) for w, k in found.items()]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                         pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())],
                        ["words", "hash", "window", "item_id"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             whole().cast("binary").alias("text"))
    return mapped(items, batches, "words int, hash bigint, window binary, item_id string").distinct()


def _window_set(rows: list, lengths: list[int], bits: int) -> WindowSet:
    of: dict[bytes, set[str]] = defaultdict(set)
    value = {}
    for r in rows:
        window = bytes(r["window"])
        of[window].add(r["item_id"])
        value[window] = r["hash"] & MASK
    order = sorted(value, key=lambda w: (value[w], w))
    found = np.array([value[w] for w in order], np.uint64)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[found >> np.uint64(64 - bits)] = True
    return WindowSet(bits, lengths, bitmap, found, order, [sorted(of[w]) for w in order])


def _packed_bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all hashes, put together from 64-bit groups; its size is fixed by ``bits``."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    groups = (windows.select((F.shiftright(place, 5)).alias("g"), place.bitwiseAND(F.lit(31)).cast("int").alias("b"))
              .groupBy("g").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for b in groups.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


SPANS = "array<struct<start:bigint,end:bigint>>"
HITS = f"row bigint, doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}, unsure binary"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, of: WindowSet, verify: bool, settings: Settings, carry: bool) -> DataFrame:
    """Per document its words, hit words, items and hit spans (byte ranges), or the windows that may be hits.

    With ``carry`` the document's whole row goes along as ``whole``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in some:
            for first, upto, raw, ends in texts_of(b, 1):
                words = Words(raw, ends)
                hit = np.zeros(len(words) + 1, np.int64)
                items: dict[int, set[str]] = defaultdict(set)
                unsure: dict[int, list] = defaultdict(list)
                for n in known.lengths:
                    for p, q in pieces(words, n, settings.piece):
                        value = hashes(words, n, p, q)
                        inside = words.text_of[p:q] == words.text_of[p + n - 1:q + n - 1]
                        for i in np.flatnonzero(known.maybe(value) & inside).tolist():
                            window, text = words.window(p + i, n), int(words.text_of[p + i])
                            if not verify:
                                unsure[text].append((p + i, n, window))
                                continue
                            k = known.find(value[i], window)
                            if k >= 0:
                                hit[p + i] += 1
                                hit[p + i + n] -= 1
                                items[text].update(known.items[k])
                covered = np.cumsum(hit[:-1]) > 0
                n_words = np.bincount(words.text_of, minlength=upto - first)
                n_hit = np.bincount(words.text_of[covered], minlength=upto - first)
                base = np.concatenate([[0], ends[:-1]])
                cuts = np.searchsorted(words.text_of, np.arange(upto - first + 1))
                spans, left = [], []
                for t in range(upto - first):
                    spans.append(_spans(words, covered, cuts[t], cuts[t + 1], base[t]) if n_hit[t] else [])
                    left.append(_unsure(words, unsure[t], cuts[t], cuts[t + 1], base[t]) if t in unsure else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + upto - first)), b.column(0).slice(first, upto - first),
                     pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array([sorted(items[t]) if t in items else [] for t in range(upto - first)],
                              pa.list_(pa.string())),
                     pa.array(spans, SPAN_TYPE), pa.array(left, pa.binary()),
                     *(c.slice(first, upto - first) for c in b.columns[2:])], names)
                row += upto - first

    names = ["row", "doc_id", "n_words", "n_hit", "items", "spans", "unsure"]
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), whole().cast("binary").alias("text")]
    schema = T._parse_datatype_string(HITS)
    if carry:
        rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
        columns.append(rows)
        schema.add("whole", docs.select(rows).schema[0].dataType)
        names.append("whole")
    return mapped(docs.select(*columns), batches, schema)


def _spans(words: Words, covered: np.ndarray, p: int, q: int, base: int) -> list[dict]:
    """Byte ranges of the runs of hit words of one text."""
    edges = np.flatnonzero(np.diff(covered[p:q].astype(np.int8), prepend=0, append=0))
    starts, ends = words.start[p + edges[::2]] - base, words.end[p + edges[1::2] - 1] - base
    return [{"start": a, "end": z} for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]


def _unsure(words: Words, found: list, p: int, q: int, base: int) -> bytes:
    """Windows that passed the bitmap: place, words, byte range, bytes."""
    table = pa.table({
        "at": pa.array([i - p for i, _, _ in found], pa.int64()), "n": pa.array([n for _, n, _ in found], pa.int64()),
        "start": pa.array([words.start[i] - base for i, _, _ in found], pa.int64()),
        "end": pa.array([words.end[i + n - 1] - base for i, n, _ in found], pa.int64()),
        "window": pa.array([w for _, _, w in found], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unfolded(found: DataFrame) -> DataFrame:
    """A row per window of ``unsure``."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for row, body in zip(b.column(0), b.column(1), strict=True):
                got = pa.ipc.open_stream(body.as_buffer()).read_all()
                for part in got.append_column("row", pa.array([row.as_py()] * got.num_rows, pa.int64())).to_batches():
                    yield part

    return mapped(found.filter("unsure is not null").select("row", "unsure"), batches,
                  "at bigint, n bigint, start bigint, end bigint, window binary, row bigint")


def _joined(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits among the written windows, by a join on the window itself; one row per document."""
    found = staged(found, "window-candidates")
    # A window that most documents hold meets one row: the items come later, once per document and window.
    one = windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("of"))
    hits = _unfolded(found).join(one, "window")
    per = hits.groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_set("of"))).alias("items"),
        F.sort_array(F.collect_list(F.struct("at", "n", "start", "end"))).alias("runs"))

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            out = []
            for runs in b.column(2).to_pylist():
                done, ranges, upto = 0, [], -1
                for r in runs:
                    done += max(0, r["at"] + r["n"] - max(r["at"], upto))
                    if ranges and r["at"] <= upto:
                        ranges[-1]["end"] = max(ranges[-1]["end"], r["end"])
                    else:
                        ranges.append({"start": r["start"], "end": r["end"]})
                    upto = max(upto, r["at"] + r["n"])
                out.append((done, ranges))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], SPAN_TYPE)], ["row", "items", "n_hit", "spans"])

    per = mapped(per.select("row", F.array_distinct("items").alias("items"), "runs"), batches,
                 f"row bigint, items array<string>, n_hit bigint, spans {SPANS}")
    carried = [c for c in found.columns if c == "whole"]
    return (found.select("row", "doc_id", "n_words", *carried).join(per, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), *carried))


def scan(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of each row of ``docs``.

    ``n_hit``: words inside any occurrence of a window of the benchmark; ``items``: ids of
    the items with such windows, sorted as text; ``spans``: byte ranges of the hit runs.
    A null text has no words; repeated rows, null ids and very long texts are rows like others
    (texts are hashed in pieces that overlap by a window); an empty table on either side
    gives no rows and no hits. Only ``doc_id``, ``text`` and ``item_id`` are read, unless
    ``carry`` asks for each whole row as ``whole``.
    """
    windows = staged(benchmark_windows(benchmark, settings), "benchmark-windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 100).alias("bytes"),
                       F.sort_array(F.collect_set("words")).alias("lengths")).first()
    small = (size["bytes"] or 0) <= settings.most_bytes
    if small:
        of = _window_set(windows.collect(), size["lengths"], settings.bitmap_bits)
        return _scan(docs, of, True, settings, carry).drop("unsure", "row")
    bitmap = _packed_bitmap(windows, settings.bitmap_bits)
    of = WindowSet(settings.bitmap_bits, size["lengths"], bitmap, np.empty(0, np.uint64), [], [])
    return _joined(_scan(docs, of, False, settings, carry), windows)


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row; see ``scan``."""
    found = scan(docs, benchmark, settings)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; columns unchanged."""
    return scan(docs, benchmark, settings, carry=True).filter("n_hit = 0").select("whole.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.5,
                 settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the hit runs of words cut out of the texts, what lies between them unchanged.

    Rows of which more than ``most_share`` of the words are hit go altogether.
    """
    found = scan(docs, benchmark, settings, carry=True).filter(F.col("n_hit") <= F.lit(most_share) * F.col("n_words"))
    raw = F.col("whole.text").cast("binary")
    piece = lambda start, end: F.substring(raw, start + 1, end - start)
    first = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("bigint").alias("upto"))
    step = lambda acc, span: F.struct(
        F.concat(acc["out"], piece(acc["upto"], span["start"])).alias("out"), span["end"].alias("upto"))
    cut = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], piece(acc["upto"], F.octet_length(raw))))
    text = F.when(F.size("spans") > 0, F.decode(cut, "utf-8")).otherwise(F.col("whole.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns])
