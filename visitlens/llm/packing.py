"""Packing of documents into sequences by minimum bin slack.

Bins are planned on the histogram of lengths, which has at most ``capacity``
rows however many documents there are. Each step takes the longest length left,
finds by a bitset subset-sum over the lengths left the fullest feasible bin with
it, and uses that bin as often as the counts allow. Pieces are then numbered
within their length and dealt to the places of the plan. Texts never shuffle.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.common import by_bytes, flat, mapped, staged, told_apart, whole

VOCABULARY = "word_bpe_49k.json"
SEPARATOR = 0
CAPACITY = 2048
#: Rows that one task numbers; more rows mean more tasks, not longer ones.
RANKED_ROWS = 20_000
#: How the vocabulary cuts a text into units.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the tokenizer's normalising leaves as they are and that are one unit each.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _borders() -> np.ndarray:
    """For each two bytes, as a number of 16 bits, whether one of the ``UNITS`` ends between them
    in any text: in front of a digit or a mark behind a letter or digit, and behind a digit.

    A special token's name has a bar behind a letter.
    """
    out = np.zeros((256, 256), bool)
    letters, digits = list(string.ascii_letters.encode()), list(string.digits.encode())
    marks = list(string.punctuation.replace("|", "").encode())
    out[np.ix_(letters + digits, digits + marks)] = True
    out[np.ix_(digits, letters)] = True
    return out.ravel()


BORDERS = _borders()


class WordEncoder:
    """Token ids of texts, part by part, with a memory of parts seen.

    The tokenizer drops white space and lets no token cross it nor a border between units, so a text's
    ids are those of its parts. A batch of texts is cut at once and its different parts looked up.
    The memory holds up to twice ``most_words`` parts, those lately seen, beside those of a batch;
    no result depends on it. Vocabularies of other units are cut at white space alone.
    """

    def __init__(self, path: str, most_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most_words = most_words
        size = self.tokenizer.get_vocab_size()
        self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in LATIN}
        self.model = self.tokenizer.model
        # Asked of this part alone: the whole vocabulary as JSON would stay in the worker's memory.
        cut = self.tokenizer.pre_tokenizer
        self.usual = cut is not None and json.dumps(UNITS) in json.dumps(json.loads(cut.__getstate__()))
        self.borders = BORDERS if self.usual else np.zeros_like(BORDERS)

    def _plain_ids(self, word: bytes) -> bytes:
        """Ids of a plain word by the merges alone, without normalising and cutting it again."""
        text = word.decode()
        text = text if text.isascii() else text.translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words of letters only are one unit of the vocabulary, whose last
        token is marked as an end, so many of them are encoded as one text and cut at the marks."""
        out = [self._plain_ids(w) if self.usual and PLAIN.fullmatch(w) else b"" for w in words]
        texts = ["" if x else w.decode() for w, x in zip(words, out, strict=True)]
        letters = [i for i, t in enumerate(texts) if t and unicodedata.normalize("NFC", t).lower().isalpha()]
        for at in range(0, len(letters), 2000):
            some = letters[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])],
                                                            add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                body, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                for i, p, q in zip(some, cuts, cuts[1:], strict=False):
                    out[i] = body[p:q]
        rest = [i for i, x in enumerate(out) if not x]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some different words."""
        if len(self.known) > self.most_words:
            self.known, self.old = {}, self.known
        known, old, missing = self.known, self.old, []
        for w in words:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        known.update(zip(missing, self._ids(missing), strict=True))
        return list(map(known.__getitem__, words))

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_binary())
        data, offsets = flat(texts)
        # The special tokens' names are matched in lower case only.
        lower = LOWER[data]
        for i in np.flatnonzero(pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False)).tolist():
            lower[offsets[i]:offsets[i + 1]] = data[offsets[i]:offsets[i + 1]]
        inside = ~WHITE[lower]
        first = np.ones(len(lower), bool)
        first[1:] = self.borders[lower[:-1].astype(np.uint16) << 8 | lower[1:]] | ~inside[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first[inside])
        if not len(starts):
            return [b""] * len(texts)
        before = np.concatenate([[0], np.cumsum(inside)])[offsets]
        words, which = told_apart(lower[inside], starts)
        bodies = pa.array(self._learn(words.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids, places = flat(bodies.take(pa.array(which)))
        cuts = places[np.searchsorted(starts, before)].tolist()
        return [ids[p:q].tobytes() for p, q in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the closing
    separator, cut only where longer than ``capacity``."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(public_tokenizers.path(vocabulary)).encode
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in (part for whole_batch in some for part in by_bytes(whole_batch)):
            rows: list[tuple] = []
            for i, found in enumerate(encode(b.column(1))):
                ids = memoryview(found + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            at, k, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (
                np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().cast("binary").alias("text")),
                  batches, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Use of each length in the fullest bin that holds the longest length left.

    Bit s of ``reach`` says that some choice sums to s. Lengths are added from
    the longest down, each as often as its count and the bin allow (in powers of
    two), and the search ends early when the bin can be full; longer pieces,
    which are harder to place later, are used first.
    """
    seed = max(counts)
    room, bits = capacity - seed, (1 << capacity - seed + 1) - 1
    left = {k: v - (k == seed) for k, v in counts.items()}
    reach, trail = 1, []
    for length in sorted((k for k, v in left.items() if v and k <= room), reverse=True):
        many, step = min(left[length], room // length), 1
        while many:
            take = min(step, many)
            more = reach | (reach << take * length) & bits
            if more != reach:
                trail.append((reach, length, take))
                reach = more
            many, step = many - take, step * 2
        if reach >> room & 1:
            break
    at, use = reach.bit_length() - 1, {seed: 1}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            use[length] = use.get(length, 0) + take
            at -= take * length
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: ``length, first rank, ranks, first sequence, times, first offset``.

    A bin pattern is used as often as its lengths last, so every step uses up the
    supply of some length for that pattern; the list is bounded by the capacity,
    not by the number of documents.
    """
    counts = {k: v for k, v in histogram.items() if v}
    used, places, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        use = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in use.items())
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            places.append((length, used[length], n * times, sequence, times, offset))
            used[length] += n * times
            offset += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return places


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank``, 0 and up within each length.

    A length may hold a third of all rows: rows are dealt by a hash of their
    number, counted per length and share, and numbered share by share.
    """
    shares = max(1, -(-total // RANKED_ROWS))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("row_no"), F.lit(shares)))
    before = dealt.groupBy("length", "share").count().select(
        "length", "share",
        (F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "row_no"))
    return (dealt.withColumn("number", number).join(before, ["length", "share"])
            .withColumn("rank", F.col("before") + F.col("number") - 1).drop("share", "number", "before"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    A null or empty text is a document of the separator alone. Repeated rows are
    documents of their own. An empty table gives no rows. Only ``doc_id`` and
    ``text`` are read. Ties between pieces of one length are broken by id, piece
    and row.
    """
    cut = staged(pieces(docs, vocabulary, capacity).withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)

    def deal(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] << 48 | places[:, 1]
        for b in some:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            found = places[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(rank) else places[:0]
            copy, which = np.divmod(rank - found[:, 1], found[:, 4]) if len(rank) else (rank, rank)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(5)] + [pa.array(found[:, 3] + which),
                                                   pa.array(found[:, 5] + copy * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = ranked(cut, sum(histogram.values())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return mapped(numbered, deal, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                  "sequence_id bigint, offset bigint")
