"""Class-based bigram language model (Brown et al.), trained by exchange clustering.

``log P(text)`` is the sum over its tokens of ``log P(class | class before) +
log P(word | class)``. Words go to classes by exchange: each round scores every word in every
class by the pointwise information between that class and the classes around the
word (its own share taken out of its own class), and moves it to the best.

How it is laid out. Texts are cut into blocks of some million tokens. A block keeps its
texts as numbers into its own word list. The lists are cut by a hash of the word into shares, and the
parts of a share, one from each block, meet in one task that counts its words over the whole corpus
and tells each block. So a task holds the words of one block or of one share,
never the vocabulary; a part of a list moves as one row, and texts and lists are written once, bucketed by
block, and do not move again. A round moves what stands around the words to the
shares and a byte for each word of a block back. Only the transition counts between classes, at
most the square of their number, are gathered.
"""

from __future__ import annotations

import gc
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import flat, mapped, told_apart, whole
from visitlens.session import new_folder

#: The end of a text, counted as a token; no word is empty.
END = b""
#: More different words than a block has tokens.
LOCAL_BITS = 22
#: Tokens of a block for each share of the words.
SHARE = 2048
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The largest count that two bytes hold.
MOST = 65535
#: A byte tells a class before a word from one after it.
MOST_CLASSES = 128


@dataclass(frozen=True)
class Settings:
    """``classes`` (at most 128) bounds the transition table. Every word seen in training takes part in
    the exchange. Rounds end when one raises the information of classes by less than ``least_gain`` of
    it, or after ``rounds``; a round that lowers it is undone. ``block_tokens`` bounds a task's memory."""

    classes: int = 64
    rounds: int = 2
    least_gain: float = 0.001
    block_tokens: int = 1_500_000
    add_transition: float = 0.1
    add_word: float = 0.5

    def __post_init__(self):
        if self.block_tokens >= 1 << LOCAL_BITS:
            raise ValueError(f"block_tokens must be below {1 << LOCAL_BITS}")
        if not 2 <= self.classes <= MOST_CLASSES:
            raise ValueError(f"classes must be 2 to {MOST_CLASSES}, not {self.classes}")

    @property
    def shares(self) -> int:
        """Shares of the words: a block has some hundred words in each, so that few rows move."""
        return 1 + self.block_tokens // SHARE


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of texts end to end, where each begins, and the number of words of each text."""
    data, offsets = flat(texts)
    data = LOWER[data]
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = solid[at]
    return data[solid], np.flatnonzero(begins[solid]), np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def first_class(words: list[bytes] | pa.Array, classes: int) -> np.ndarray:
    """Class by a word's last two bytes, 1 and up; class 0 is the end of a text."""
    data, offsets = flat(words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary()))
    size, data = np.diff(offsets), np.append(data, (0, 0)).astype(np.int64)
    one, two = data[offsets[1:] - 1], data[offsets[1:] - 2]
    last = np.where(size > 1, two + 256 * one, one) + 1
    return np.where(size > 0, 1 + last * 40503 % 65521 % (classes - 1), 0)


def held_out_flag(doc_id: Column, of: int = 7, at: int = 2) -> Column:
    """Rows kept from training; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == at


def _blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of two kinds: a block's texts, and a row per share with the words of its list in that share."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            block, n = part << 18 | n, n + 1
            docs, out, per, starts, data = zip(*held, strict=True)
            before = np.cumsum([0, *map(len, data)])
            words, which = told_apart(np.concatenate(data), np.concatenate([x + b for x, b in zip(starts, before)]))
            words = pa.concat_arrays([pa.array([END], pa.large_binary()), words])
            doc_ids, out, lengths = pa.concat_arrays(docs), pa.concat_arrays(out), np.concatenate(per) + 1
            inside = np.ones(lengths.sum(), bool)
            inside[np.cumsum(lengths) - 1] = False
            ids = np.zeros(len(inside), np.int32)
            ids[inside] = which + 1
            taught = np.repeat(~np.asarray(out.to_numpy(zero_copy_only=False), bool), lengths)
            counts = np.bincount(ids[taught], minlength=len(words))
            yield _batch(_BLOCKS, block=[block], doc_ids=pa.ListArray.from_arrays([0, len(out)], doc_ids),
                         held_out=pa.ListArray.from_arrays([0, len(out)], out), lengths=[lengths],
                         ids=[_planes(ids, "<i4").tobytes()],
                         first=[first_class(words, s.classes).astype("u1").tobytes()])
            share = np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)) % s.shares
            order = np.argsort(share, kind="stable")
            share = share[order]
            cuts = np.flatnonzero(np.diff(share, prepend=-1))
            data, ends = flat(words.take(pa.array(order)))
            yield _batch(_BLOCKS, block=np.full(len(cuts), block), share=share[cuts].astype(np.int32),
                         words=_cut(data, np.append(ends[cuts], len(data))), sizes=_parts(np.diff(ends), "<i4", cuts),
                         local=_parts(order, "<i4", cuts), n=_parts(counts[order], "<i4", cuts))

        for b in some:
            data, starts, per = _words(b.column(2))
            # Words and bytes before each text, and tokens up to its end.
            first = np.append(0, np.cumsum(per))
            bytes_ = np.append(starts, len(data))[first]
            ends, at = first[1:] + np.arange(1, len(per) + 1), 0
            while at < len(per):
                before = ends[at - 1] if at else 0
                upto = min(len(per), int(np.searchsorted(ends, before + s.block_tokens - size)) + 1)
                held.append((b.column(0).slice(at, upto - at), b.column(1).slice(at, upto - at), per[at:upto],
                             starts[first[at]:first[upto]] - bytes_[at], data[bytes_[at]:bytes_[upto]]))
                size += ends[upto - 1] - before
                at = upto
                if size >= s.block_tokens:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                              held_out_flag(F.col("doc_id")).alias("held_out"), whole().cast("binary").alias("text")),
                  batches, "block bigint, share int, words binary, sizes binary, local binary, n binary, doc_ids array<bigint>, "
                           "held_out array<boolean>, lengths array<bigint>, ids binary, first binary")


_BLOCKS = pa.schema([("block", pa.int64()), ("share", pa.int32()), *[(x, pa.binary()) for x in (
    "words", "sizes", "local", "n")], ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("first", pa.binary())])
#: A share of the words: with no block, its different words, ``strong`` of them first that take part in the exchange;
#: with a block, the entries of the words in that block's list.
_SHARES = pa.schema([("share", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in (
    "part", "words", "sizes", "n", "first")], ("strong", pa.int64())])
#: What stands around the words of a block and a share.
_AROUND = pa.schema([("share", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in (
    "index", "class", "keys", "what", "times")]])


def _batch(schema: pa.Schema, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    given = {x: y if isinstance(y, pa.Array) else pa.array(y, schema.field(x).type) for x, y in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in schema],
                                      schema=schema)


def _planes(values: np.ndarray, kind: str) -> np.ndarray:
    """First bytes of all values, then the second bytes, and so on, a row each: that takes less disk."""
    values = np.ascontiguousarray(values.astype(kind))
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def _values(data: bytes, kind: str | np.dtype) -> np.ndarray:
    """What ``_planes`` took apart."""
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.ravel().view(kind)


def _parts(values: np.ndarray, kind: str, cuts: np.ndarray) -> list[bytes]:
    """``_planes`` of each part of ``values``; parts begin at ``cuts``."""
    planes = _planes(values, kind)
    return [planes[:, a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(values)))]


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of ``data`` between ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)),
                                                              pa.py_buffer(np.ascontiguousarray(data))])


def _met(some: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Each share with its rows, which come one after the other."""
    now, held = None, []
    for b in some:
        for row in b.to_pylist():
            if row["share"] != now:
                if held:
                    yield now, held
                now, held = row["share"], []
            held.append(row)
    if held:
        yield now, held


def _counted(classes: int):
    """A share's rows of all blocks into its different words, with what the corpus counts, and each block's entries."""

    def count(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in _met(some):
            sizes = [_values(r["sizes"], "<i4") for r in rows]
            ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
            data = np.frombuffer(b"".join(r["words"] for r in rows), np.uint8)
            words, which = told_apart(data, np.append(0, ends[:-1]))
            n = np.bincount(which, np.concatenate([_values(r["n"], "<i4") for r in rows]), len(words)).astype(np.int64)
            strong = (n > 0) & (pc.binary_length(words).to_numpy() > 0)
            order = np.argsort(~strong, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            entry = np.empty(len(which), ENTRY)
            entry["local"], entry["n"] = np.concatenate([_values(r["local"], "<i4") for r in rows]), n[which]
            entry["id"] = np.where(strong[which], share << 32 | rank[which], -1)
            lengths = [len(x) for x in sizes]
            parts = _parts(entry, ENTRY, np.cumsum(lengths) - lengths)
            for at in range(0, len(rows), 256):
                some = rows[at:at + 256]
                yield _batch(_SHARES, share=[share] * len(some), block=[r["block"] for r in some], part=parts[at:at + 256])
            words = words.take(pa.array(order))
            yield _batch(_SHARES, share=[share], words=[flat(words)[0].tobytes()],
                         sizes=[_planes(np.diff(flat(words)[1]), "<i4").tobytes()],
                         n=[_planes(n[order], "<i8").tobytes()],
                         first=[first_class(words, classes).astype("u1").tobytes()], strong=[int(strong.sum())])

    return count


def _log_ratio(matrix: np.ndarray) -> np.ndarray:
    """Pointwise information of class pairs, with a small count added everywhere."""
    m = matrix + 0.1
    return np.log(m) - np.log(m.sum(1, keepdims=True)) - np.log(m.sum(0, keepdims=True)) + math.log(m.sum())


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class each word fits best; class 0 takes no word.

    ``left`` and ``right`` count the classes before and after each word. In its own
    class a word is scored without what it brought there itself.
    """
    info = _log_ratio(matrix)
    score = left @ info + right @ info.T
    total = matrix.sum()
    rows = np.arange(len(own))
    before = np.maximum(matrix[:, own].T - left, 0) + 0.1
    after = np.maximum(matrix[own, :] - right, 0) + 0.1
    n_before, n_after = matrix.sum(1), matrix.sum(0)
    size_in = np.maximum(n_after[own] - left.sum(1), 0) + 0.1 * len(matrix)
    size_out = np.maximum(n_before[own] - right.sum(1), 0) + 0.1 * len(matrix)
    without = ((left * (np.log(before) - np.log(n_before + 0.1 * len(matrix)) + math.log(total + 1))).sum(1)
               - left.sum(1) * np.log(size_in)
               + (right * (np.log(after) - np.log(n_after + 0.1 * len(matrix)) + math.log(total + 1))).sum(1)
               - right.sum(1) * np.log(size_out))
    score[rows, own] = without
    score[:, 0] = -np.inf
    return score.argmax(1)


class Corpus:
    """The corpus in blocks, with its word counts, ready for rounds and scoring.

    ``words`` holds ``share, classes``: a byte for each word of a share that is seen in training; others
    are in the class of their ending, which a block works out by itself. The
    tables of texts, word lists and moved classes are all bucketed by block.
    """

    def __init__(self, docs: DataFrame, settings: Settings):
        self.s, self.spark = settings, docs.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self._bucketed(_blocks(docs, settings), "lm-blocks")
        self.texts = rows.filter("share is null").select("block", "doc_ids", "held_out", "lengths", "ids", "first")
        # The lists move once by share. A word is in a block's list once; its place in its share is its number.
        lists = self._by_share(rows.filter("share is not null")
                               .select("share", "block", "words", "sizes", "local", "n"))
        rows = self._written(mapped(lists, _counted(settings.classes),
                                    "share int, block bigint, part binary, words binary, sizes binary, n binary, "
                                    "first binary, strong bigint"), "lm-shares")
        del lists
        self._free()
        self.shares = rows.filter("block is null").select("share", "words", "sizes", "n", "first", "strong")
        self._entries = rows.filter("block is not null").select("block", "part")
        self.lists = self._bucketed(self._entries.groupBy("block").agg(F.collect_list("part").alias("list")),
                                    "lm-lists")
        self.words = self.shares.filter("strong > 0").select(
            "share", F.expr("substring(first, 1, int(strong))").alias("classes"))
        #: Words of a round and the classes that its blocks got.
        self._moved: list[tuple[DataFrame, DataFrame | None]] = [(self.words, None)]
        self._matrix: tuple[DataFrame | None, np.ndarray | None] = (None, None)
        self._free()
        sizes = self.sizes(self.words).sum(0)
        self.tokens, self.types = int(sizes[0]), int(sizes[1])

    def _free(self) -> None:
        """Shuffle files go with the frames that wrote them, once both sides' memory is cleaned."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _bucketed(self, rows: DataFrame, label: str) -> DataFrame:
        """The rows written once, bucketed by block, so that joins on block move nothing."""
        name = label.replace("-", "_") + "_" + uuid.uuid4().hex[:12]
        (rows.write.bucketBy(self.buckets, "block").option("compression", "zstd").format("parquet")
         .saveAsTable(name, path=new_folder(self.spark, label)))
        return self.spark.table(name)

    def _written(self, rows: DataFrame, label: str) -> DataFrame:
        """``staged``, with packed rows in less disk."""
        path = new_folder(self.spark, label)
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _by_share(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("share").sortWithinPartitions("share", "block")

    @property
    def places(self) -> DataFrame:
        """A row per word of a block's list, to look at: ``block, local, n, id, strong``; ``id`` -1 without ``strong``."""

        def rows(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _single(some):
                entry = _values(row.column(1)[0].as_py(), ENTRY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column(0)[0].as_py()] * len(entry)),
                     *[pa.array(entry[x]) for x in ("local", "n", "id")], pa.array(entry["id"] >= 0)],
                    ["block", "local", "n", "id", "strong"])

        return mapped(self._entries, rows, "block bigint, local int, n bigint, id bigint, strong boolean")

    def named(self, words: DataFrame) -> DataFrame:
        """Rows ``word, n, class, changed`` of ``words``; ``changed``: not in the class of its ending any more."""

        def rows(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in some for r in b.to_pylist()):
                z = slice(0, row["strong"])
                ends = np.append(0, np.cumsum(_values(row["sizes"], "<i4")[z]))
                own, first = (np.frombuffer(row[x], np.uint8)[z] for x in ("classes", "first"))
                yield pa.RecordBatch.from_arrays(
                    [_cut(np.frombuffer(row["words"], np.uint8), ends), pa.array(_values(row["n"], "<i8")[z]),
                     pa.array(own.astype(np.int32)), pa.array(own != first)], ["word", "n", "class", "changed"])

        return mapped(self.shares.join(words, "share"), rows, "word binary, n bigint, class int, changed boolean")

    def _joined(self, words: DataFrame, *more: str) -> DataFrame:
        """Texts of each block, with its list and the classes of its words if they left their first ones, and ``more``."""
        moved = next(m for w, m in self._moved if w is words)
        both = self.texts
        if more or moved is not None:
            both = both.join(self.lists, "block")
        if moved is None:
            both = both.withColumn("moved", F.lit(None).cast("array<struct<share:int,classes:binary>>"))
        else:
            both = both.join(moved, "block", "left")
        return both.select("ids", "lengths", "held_out", "first", "moved",
                           "list" if "list" in both.columns else F.lit(None).cast("array<binary>").alias("list"),
                           *[c for c in more if c != "list"])

    def pairs(self, words: DataFrame) -> np.ndarray:
        """Counts of class pairs in training, summed before they are gathered (the square of the classes at most)."""
        if self._matrix[0] is words:
            return self._matrix[1]
        k = self.s.classes

        def count(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k, np.int64)
            for row in _single(some):
                seq, lengths, out, classes = _block(row)
                seq = classes[seq[np.repeat(~out, lengths)]].astype(np.int64)
                total += np.bincount(np.concatenate(([0], seq[:-1])) * k + seq, minlength=k * k) if len(seq) else 0
            pair = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

        rows = mapped(self._joined(words), count, "pair bigint, n bigint")
        out = np.zeros(k * k)
        for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
            out[r["pair"]] = r["n"]
        self._matrix = (words, out.reshape(k, k))
        return self._matrix[1]

    def information(self, words: DataFrame) -> float:
        """Mutual information of neighbouring classes, in nats: what exchange is to raise."""
        p = self.pairs(words)
        p = p / max(p.sum(), 1)
        seen = p > 0
        return float((p[seen] * np.log(p[seen] / np.outer(p.sum(1), p.sum(0))[seen])).sum())

    def trained(self) -> tuple[DataFrame, list[float]]:
        """Words in their last classes, and the information before the first round and after each that counts."""
        words = self.words
        steps = [self.information(words)]
        for _ in range(self.s.rounds):
            before = self._matrix
            moved = self.exchange(words)
            gained = self.information(moved) - steps[-1]
            if gained <= 0:
                # All words moved at once may do worse together; then they stay where they were.
                self._matrix = before
                break
            words = moved
            steps.append(steps[-1] + gained)
            if gained < self.s.least_gain * steps[-1]:
                break
        return words, steps

    def contexts(self, words: DataFrame) -> DataFrame:
        """Rows ``share, block, index, class, keys, what, times`` for words seen in training.

        ``index`` tells the words in their share, ``class`` the class of each and ``keys`` how many follow for it:
        ``what`` has a byte per class before the word, or after it (from ``classes``
        up), and ``times`` two bytes with its count; larger counts are told in parts.
        """
        k = self.s.classes

        def count(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _single(some):
                block, (seq, lengths, out, classes) = row.column(6)[0].as_py(), _block(row)
                _, name = _list(row.column(5))
                mine = _strong(name)
                at = np.full(len(name), -1, np.int32 if len(mine) * 2 * k < 1 << 31 else np.int64)
                at[mine] = np.arange(len(mine))
                seq = seq[np.repeat(~out, lengths)]
                here, own = at[seq], classes[seq].astype(at.dtype)
                there, before = (np.append(at.dtype.type(x), y)[:len(seq)] for x, y in ((-1, here), (0, own)))
                key = np.concatenate(((here * (2 * k) + before)[here >= 0], (there * (2 * k) + k + own)[there >= 0]))
                key.sort()
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
                key, times = key[starts], np.diff(starts, append=len(key))
                parts = (times - 1) // MOST + 1
                last = np.cumsum(parts) - 1
                key, rest = np.repeat(key, parts), times - (parts - 1) * MOST
                times = np.full(len(key), MOST, np.int64)
                times[last] = rest
                who, what = np.divmod(key, 2 * k)
                keys = np.bincount(who, minlength=len(mine))
                share, index = name[mine] >> 32, name[mine] & 0xFFFFFFFF
                cuts = np.flatnonzero(np.diff(share, prepend=-1))
                ends = np.append(0, np.cumsum(keys))[np.append(cuts, len(mine))]
                yield _batch(_AROUND, share=share[cuts].astype(np.int32), block=[block] * len(cuts),
                             index=_parts(index, "<i4", cuts), keys=_parts(keys, "<i4", cuts),
                             what=_cut(what.astype("u1"), ends), times=_parts(times, "<u2", ends[:-1]),
                             **{"class": _cut(classes[mine].astype("u1"), np.append(cuts, len(mine)))})

        return mapped(self._joined(words, "list", "block"), count, "share int, block bigint, index binary, class binary, "
                                                                   "keys binary, what binary, times binary")

    def exchange(self, words: DataFrame) -> DataFrame:
        """``words`` with each word in its best class.

        A share's rows come one after the other and are added up as they come; what is kept of a block's row
        is which words are to be told.
        """
        k, matrix = self.s.classes, self.pairs(words)

        def moved(share: int, asked: list[tuple[int, np.ndarray]], own: np.ndarray,
                  counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.empty(len(own), np.uint8)
            for at in range(0, len(own), 2_000):
                z = slice(at, at + 2_000)
                new[z] = best_classes(counts[z, :k], counts[z, k:], own[z], matrix)
            blocks, classes = [None, *[b for b, _ in asked]], [new.tobytes(), *[new[i].tobytes() for _, i in asked]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), share, np.int32)), pa.array(blocks, pa.int64()),
                 pa.array(classes, pa.binary())], ["share", "block", "classes"])

        def move(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, asked, size = None, [], 0
            own, counts = np.zeros(0, np.int64), np.zeros((0, 2 * k))
            for row in (r for b in some for r in b.to_pylist()):
                if row["share"] != now:
                    if asked:
                        yield from moved(now, asked, own[:size], counts[:size])
                    now, asked, size = row["share"], [], 0
                    own, counts = np.zeros(0, np.int64), np.zeros((0, 2 * k))
                index = _values(row["index"], "<i4")
                size = max(size, int(index[-1]) + 1)
                if size > len(own):
                    own = np.append(own, np.zeros(2 * size - len(own), np.int64))
                    counts = np.append(counts, np.zeros((2 * size - len(counts), 2 * k)), 0)
                own[index] = np.frombuffer(row["class"], np.uint8)
                who = np.repeat(index.astype(np.int64), _values(row["keys"], "<i4"))
                np.add.at(counts.reshape(-1), who * (2 * k) + np.frombuffer(row["what"], np.uint8),
                          _values(row["times"], "<u2").astype(float))
                asked.append((row["block"], index))
            if asked:
                yield from moved(now, asked, own[:size], counts[:size])

        rows = self._written(mapped(self._by_share(self.contexts(words)), move,
                                    "share int, block bigint, classes binary"), "lm-words")
        self._free()
        out = rows.filter("block is null").select("share", "classes")
        told = self._bucketed(rows.filter("block is not null").groupBy("block").agg(
            F.collect_list(F.struct("share", "classes")).alias("moved")), "lm-moved")
        self._moved.append((out, told))
        return out

    def sizes(self, words: DataFrame) -> np.ndarray:
        """Tokens and different words of each class in training; a row per class."""
        k = self.s.classes

        def count(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, v = np.zeros(k, np.int64), np.zeros(k, np.int64)
            for row in (r for b in some for r in b.to_pylist()):
                times, own = _values(row["n"], "<i8"), np.frombuffer(row["first"], np.uint8).copy()
                own[:row["strong"]] = np.frombuffer(row["classes"] or b"", np.uint8)
                n += np.bincount(own, times, k).astype(np.int64)
                v += np.bincount(own[times > 0], minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(v)],
                                             ["class", "n", "v"])

        out = np.zeros((k, 2))
        rows = mapped(self.shares.select("share", "n", "first", "strong").join(words, "share", "left"), count,
                      "class int, n bigint, v bigint")
        for r in rows.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            out[r["class"]] = r["n"], r["v"]
        return out

    def score(self, words: DataFrame) -> DataFrame:
        """Scores of every text with the given classes."""
        s, k, n_all, v_all = self.s, self.s.classes, self.tokens, self.types
        matrix, in_class = self.pairs(words), self.sizes(words)
        step = np.log10(matrix + s.add_transition) - np.log10(matrix.sum(1, keepdims=True) + k * s.add_transition)
        room = np.log10(in_class[:, 0] + s.add_word * (in_class[:, 1] + 1))

        def score(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _single(some):
                seq, lengths, out, classes = _block(row)
                count, _ = _list(row.column(5))
                base = np.log10((count + 1) / (n_all + v_all + 1))
                emit = np.log10(count + s.add_word) - room[classes]
                before = np.concatenate(([0], seq[:-1]))
                starts = np.cumsum(lengths) - lengths
                model = step[classes[before], classes[seq]] + emit[seq]
                yield pa.RecordBatch.from_arrays(
                    [row.column(6).flatten(), pa.array(out), pa.array(lengths),
                     pa.array(np.add.reduceat((count[seq] > 0).astype(np.int64), starts)),
                     pa.array(np.full(len(lengths), n_all, np.int64)), pa.array(np.add.reduceat(base[seq], starts)),
                     pa.array(np.add.reduceat(model, starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return mapped(self._joined(words, "list", "doc_ids"), score,
                      "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                      "base_score double, score double")


#: What a block's list holds of a word: its number there, its count in the corpus, its ``id``, which is its share and its
#: place there (-1 if it has no part in the exchange).
ENTRY = np.dtype([("local", "<i4"), ("n", "<i8"), ("id", "<i8")])


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids of a block's words by number; its words have the numbers 0, 1, 2, .."""
    entry = np.concatenate([_values(x.as_buffer(), ENTRY) for x in column.flatten()])
    n, name = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
    n[entry["local"]], name[entry["local"]] = entry["n"], entry["id"]
    return n, name


def _strong(name: np.ndarray) -> np.ndarray:
    """Numbers of the words that take part in the exchange, in the order of their ids."""
    mine = np.flatnonzero(name >= 0)
    return mine[np.argsort(name[mine])]


def _single(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block at a time."""
    for b in some:
        for i in range(b.num_rows):
            yield b.slice(i, 1)


def _block(row: pa.RecordBatch):
    """One block: numbers of its tokens, lengths of its texts, their flags, classes by number."""
    seq = _values(row.column(0)[0].as_buffer(), "<i4")
    lengths = np.asarray(row.column(1).flatten())
    out = np.asarray(row.column(2).flatten().to_numpy(zero_copy_only=False), bool)
    classes = np.frombuffer(row.column(3)[0].as_py(), np.uint8)
    if row.column(4)[0].is_valid:
        classes = classes.copy()
        told = sorted((x["share"], x["classes"]) for x in row.column(4)[0].as_py())
        classes[_strong(_list(row.column(5))[1])] = np.frombuffer(b"".join(x for _, x in told), np.uint8)
    return seq, lengths, out, classes


def score_texts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``base_score`` is the log10 probability by add-one word counts, ``score`` that of the class
    model. Rows with ``crc32(doc_id) mod 7 = 2`` teach nothing. A null or empty text is
    one end token. Repeated rows count again, an empty table gives no rows, and only
    ``doc_id`` and ``text`` are read. A word unseen in training has the class of its
    ending, and one share for all such words of a class.
    """
    corpus = Corpus(docs, settings)
    words, _ = corpus.trained()
    return corpus.score(words)
