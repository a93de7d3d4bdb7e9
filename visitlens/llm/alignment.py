"""Alignment of two tokenizers' ids over the same texts, with an identity-map fast path.

Both tokenizers cut the bytes of a text; where both cut, a group ends. Most groups are
one token on each side. For these a map made once, from each id of A to the id of B with
the same bytes, says the partner, so they are counted in a vector as long as A's
vocabulary. Only the last tokens of other groups are counted as pairs.

The texts are tokenised once. What a document needs later (ids of its regular
groups, its other pairs with their number) is written in a compact form. The
corpus-wide counts come back in three ways: regular ones and the highest count per B id as
vectors as long as a vocabulary, pairs that hold more than a ``1 / most_hot`` share of all links,
of which there can be no more than ``most_hot``, as a sorted list, and the rest by
a join, where no pair is hot any more.

Neither tokenizer crosses a place where a space follows something else than white space (for B
this is checked on its pieces). Texts are cut there, and each different part is
tokenised and aligned once per worker, as far as a bounded memory of parts reaches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import mapped, staged, whole

SPACE = "▁"
#: From a space to the next one behind something else than white space.
PART = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


@dataclass(frozen=True)
class Settings:
    """Files of the two vocabularies; ``most_hot`` bounds the list of frequent pairs; twice ``most_parts``
    parts of up to ``longest_part`` letters are what a worker remembers."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    most_hot: int = 100_000
    most_parts: int = 150_000
    longest_part: int = 200


def letters_of_bytes() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, as byte by letter."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(other)}}


#: Alignment of a stretch of text: both sides' numbers of tokens, number of groups, groups as text (``;`` behind
#: each), the A ids of regular groups (unsigned 32-bit), the pairs of the others (64-bit ``a << 32 | b``).
Part = tuple[int, int, int, str, bytes, bytes]


class Aligner:
    """Two tokenizers and what is known of parts seen before."""

    def __init__(self, settings: Settings):
        self.settings = settings
        with open(public_tokenizers.path(settings.a), encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model.get("added_tokens", [])}
        byte_of = letters_of_bytes()
        # An id of this vocabulary is also the rank of its merge.
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(settings.b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        plain = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        # Pieces before single bytes: a byte that is a piece too is only written as a byte in longer letters.
        of = {x: i for kind in (False, True) for i, x in enumerate(self.bytes_b) if plain[i] is kind}
        self.same = np.array([of.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.cut = not any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if plain[i])
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        shown = [str(i).encode() for i in range(most)]
        self.n_digits = np.array([len(x) for x in shown], np.int64)
        width = int(self.n_digits[-1]) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in shown), np.uint8).reshape(most, width)
        # What the last parts were, and what those before them were.
        self.young: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}

    def ids_of_a(self, text: str) -> list[int]:
        return self.a.encode_ordinary(text)

    def ids_of_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def align(self, text: str, ids_a: list[int], ids_b: list[int]) -> Part | None:
        """Alignment of a text with its leading space; None if a side's bytes are not the text's."""
        raw = text.encode()
        bytes_a, bytes_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        groups, regular, pairs = [], [], []
        i = j = from_a = from_b = at_a = at_b = 0
        # A token without bytes stays in the group that is open where it stands.
        while i < len(ids_a) or j < len(ids_b):
            if j >= len(ids_b) or (i < len(ids_a) and at_a <= at_b):
                at_a += len(bytes_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and i > from_a and j > from_b:
                a, b = ids_a[i - 1], ids_b[j - 1]
                if i - from_a == 1 == j - from_b:
                    groups.append(f"{a}|{b}")
                    if self.same[a] == b:
                        regular.append(a)
                    else:
                        pairs.append(a << 32 | b)
                else:
                    groups.append(f"{','.join(map(str, ids_a[from_a:i]))}|{','.join(map(str, ids_b[from_b:j]))}")
                    pairs.append(a << 32 | b)
                from_a, from_b = i, j
        return (len(ids_a), len(ids_b), len(groups), "".join([g + ";" for g in groups]),
                np.array(regular, "<u4").tobytes(), np.array(pairs, "<i8").tobytes())

    def cut_up(self, text: str) -> list[str]:
        """Parts of a text, with the space that both tokenizers put in front of it."""
        return PART.findall(" " + text) if self.cut else [" " + text]

    def solved(self, parts: list[str]) -> list[Part | None]:
        """Alignments of some parts. Parts that are not about white space are put behind one another and
        tokenised as one text, as neither side crosses from one to the next."""
        together = [p for p in parts if self.cut and not p[-1].isspace()]
        out = {}
        for at in range(0, len(together), 20_000):
            some = together[at:at + 20_000]
            out.update(zip(some, self._solved_together(some) or map(self._solved_alone, some), strict=True))
        return [out[p] if p in out else self._solved_alone(p) for p in parts]

    def _solved_alone(self, part: str) -> Part | None:
        return self.align(part, self.ids_of_a(part), self.ids_of_b([part[1:]])[0])

    def _solved_together(self, parts: list[str]) -> list[Part] | None:
        """Alignments of parts in a row; None if a side doesn't give all of their bytes back."""
        text = "".join(parts)
        raw, ends = text.encode(), np.cumsum([len(p.encode()) for p in parts])
        # B's merging takes longer per letter in long texts.
        few = ["".join(parts[i:i + 200])[1:] for i in range(0, len(parts), 200)]
        a = np.array(self.ids_of_a(text), np.int64)
        b = np.fromiter(chain.from_iterable(self.ids_of_b(few)), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.zeros((2, len(raw) + 1), bool)
        if (b"".join([self.bytes_a[i] for i in a.tolist()]) != raw or not self.size_a[a].all()
                or b"".join([self.bytes_b[i] for i in b.tolist()]) != raw or not self.size_b[b].all()):
            return None
        at[0, ends_a] = at[1, ends_b] = True
        if not at[:, ends].all():
            return None
        last_a, last_b = at[1, ends_a], at[0, ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        to_a, to_b = a[last_a], b[last_b]
        regular = (in_a == 1) & (in_b == 1) & (self.same[to_a] == to_b)
        part = np.repeat(np.arange(len(parts)), n_a)[last_a]
        # Groups in writing order: A's tokens of a group, then B's.
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, behind = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        behind[place_a], behind[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        n = self.n_digits[ids]
        letters = self.digits[ids]
        letters[np.arange(len(ids)), n] = behind
        text = letters[np.arange(letters.shape[1]) <= n[:, None]].tobytes().decode()
        cut = [0, *np.cumsum(n + 1)[np.cumsum(n_a + n_b) - 1].tolist()]
        keys = (to_a << 32 | to_b)[~regular].astype("<i8").tobytes()
        known = to_a[regular].astype("<u4").tobytes()
        r = [0, *(4 * np.cumsum(np.bincount(part[regular], minlength=len(parts)))).tolist()]
        k = [0, *(8 * np.cumsum(np.bincount(part[~regular], minlength=len(parts)))).tolist()]
        groups = np.bincount(part, minlength=len(parts)).tolist()
        return [(na, nb, g, text[t:u], known[v:w], keys[x:y]) for na, nb, g, t, u, v, w, x, y in
                zip(n_a.tolist(), n_b.tolist(), groups, cut, cut[1:], r, r[1:], k, k[1:], strict=False)]

    def learn(self, parts: set[str]) -> None:
        """Have the parts at hand; the least lately used half goes when there are too many."""
        if len(self.young) > self.settings.most_parts:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for p in parts:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            self.young.update(zip(new, self.solved(new), strict=True))

    def texts(self, texts: list[str]) -> list[list[Part]]:
        """Aligned parts per text; none for texts without tokens."""
        cut = [self.cut_up(t) if t else [] for t in texts]
        parts_of_all = set(chain.from_iterable(cut))
        long = {p for p in parts_of_all if len(p) > self.settings.longest_part}
        self.learn(parts_of_all - long)
        out = []
        for text, parts in zip(texts, cut, strict=True):
            got = (list(map(self.young.__getitem__, parts)) if long.isdisjoint(parts) else
                   [self.solved([p])[0] if p in long else self.young[p] for p in parts])
            if None in got:
                # What fails in a part may be made good elsewhere; only the whole text decides.
                one = self.align(" " + text, self.ids_of_a(" " + text), self.ids_of_b([text])[0])
                got = [one] if one else []
            out.append(got)
        return out


@lru_cache(maxsize=2)
def aligner(settings: Settings) -> Aligner:
    """One per worker process."""
    return Aligner(settings)


ALIGNED = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, regular binary, "
           "pairs array<bigint>, times array<bigint>, groups string")


def aligned(docs: DataFrame, settings: Settings = Settings(), keep_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: tokens and groups, the A ids of its regular groups (``regular``, unsigned
    32-bit), its other pairs (``a << 32 | b``) with their number, and, if asked for, the groups as text.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no
    tokens. Repeated rows and null ids are rows like others, an empty table gives none. A batch is taken by a few
    hundred rows, and a very long text by itself. Only ``doc_id`` and ``text`` are read.
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(settings)
        row = TaskContext.get().partitionId() << 33
        for b in some:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out = []
                for got in of.texts(part.column(1).to_pylist()):
                    n_a, n_b, n_groups, groups, regular, pairs = zip(*got, strict=True) if got else [()] * 6
                    groups = "".join(groups)[:-1]
                    pairs, times = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
                    out.append((sum(n_a), sum(n_b), sum(n_groups),
                                hashlib.sha256(groups.encode()).hexdigest() if got else "",
                                b"".join(regular), pairs, times, groups if keep_groups else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(out))), part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]),
                     pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()), _lists(cols[5]), _lists(cols[6]),
                     pa.array(cols[7], pa.string())],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "regular", "pairs", "times", "groups"])
                row += len(out)

    found = mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")), batches, ALIGNED)
    return found if keep_groups else found.drop("groups")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int64)))


def pair_counts(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pair, a, b, n, regular``: links of each pair over the whole corpus, from ``aligned`` rows.

    A task counts regular links in a vector and other pairs in sorted runs, before anything is shuffled.
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(settings).same
        vector = np.zeros(len(same), np.int64)
        pairs, times, held = [], [], 0

        def counted() -> pa.RecordBatch:
            key, of = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(of, np.concatenate(times), len(key)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.zeros(len(key), bool))], names)

        names = ["pair", "n", "regular"]
        for b in some:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u4")
                vector += np.bincount(ids, minlength=len(vector))
                pairs.append(part.column(1).flatten().to_numpy())
                times.append(part.column(2).flatten().to_numpy())
                held += len(pairs[-1])
                if held > 1 << 21:
                    yield counted()
                    pairs, times, held = [], [], 0
        if held:
            yield counted()
        seen = np.flatnonzero(vector)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen << 32 | same[seen]), pa.array(vector[seen]), pa.array(np.ones(len(seen), bool))], names)

    part = mapped(found.select("regular", "pairs", "times"), batches, "pair bigint, n bigint, regular boolean")
    # A pair of a longer group can't be a regular one too, but if it were, their links count together.
    return (part.groupBy("pair").agg(F.sum("n").alias("n"), F.max("regular").alias("regular"))
            .select("pair", F.shiftright("pair", 32).cast("int").alias("a"),
                    F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n", "regular"))


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """``(id, n)`` rows as a vector; there is at most one row per id of a vocabulary."""
    got = rows.toArrow()
    out = np.zeros(size, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def link_scores(found: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``row, n_best, count_sum`` of each row of ``found`` (written ``aligned`` rows), by the counts of its links."""
    of = aligner(settings)
    best = counts.groupBy("b").agg(F.max("n").alias("best"))
    best_of = _vector(best, len(of.bytes_b))
    regular = _vector(counts.filter("regular").select("a", "n"), len(of.same))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > total // settings.most_hot).select("pair", "n").toArrow().sort_by("pair")
    hot_pair, hot_n = hot.column(0).to_numpy(), hot.column(1).to_numpy()
    shared = found.sparkSession.sparkContext.broadcast((best_of, regular, hot_pair, hot_n))

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of, regular, hot_pair, hot_n = shared.value
        same = aligner(settings).same
        is_best = (regular == best_of[same]) & (same >= 0)
        for b in some:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                body = part.column(1).to_pylist()
                ids = np.frombuffer(b"".join(body), "<u4")
                row = np.repeat(np.arange(part.num_rows), [len(x) // 4 for x in body])
                pairs, times = (part.column(c).flatten().to_numpy() for c in (2, 3))
                pair_row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                where = np.minimum(np.searchsorted(hot_pair, pairs), max(len(hot_pair) - 1, 0))
                known = hot_pair[where] == pairs if len(hot_pair) else np.zeros(len(pairs), bool)
                n = hot_n[where[known]]
                n_best, count_sum = np.zeros((2, part.num_rows), np.int64)
                np.add.at(n_best, row, is_best[ids])
                np.add.at(count_sum, row, regular[ids])
                np.add.at(n_best, pair_row[known], times[known] * (n == best_of[pairs[known] & 0xFFFFFFFF]))
                np.add.at(count_sum, pair_row[known], times[known] * n)
                left = np.split(np.flatnonzero(~known), np.searchsorted(pair_row[~known], np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_best), pa.array(count_sum), _lists([pairs[x] for x in left]),
                     _lists([times[x] for x in left])], ["row", "n_best", "count_sum", "pairs", "times"])

    first = staged(mapped(found.select("row", "regular", "pairs", "times"), batches,
                          "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"),
                   "link-scores")
    rare = (first.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")))
    # The highest counts are a row per B id.
    known = counts.filter(F.col("n") <= total // settings.most_hot).join(F.broadcast(best), "b")
    rare = (rare.join(known.select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")), "pair")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("is_best").cast("bigint")).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return first.join(rare, "row", "left").select("row", plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def alignment(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row; see ``aligned``.

    A group's last tokens end together and no other pair of tokens does, so there is a link per group.
    ``n_best``: links whose pair has the highest count of its B id; ``count_sum``: the sum of
    the links' counts.
    """
    found = staged(aligned(docs, settings), "aligned-texts")
    counts = staged(pair_counts(found, settings), "pair-counts")
    return found.join(link_scores(found, counts, settings), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def id_map(counts: DataFrame) -> DataFrame:
    """``b, a, n``: per B id the A id it is linked with most often, of equal counts the smallest."""
    return counts.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("minus_a"))).alias("top")).select(
        "b", (-F.col("top.minus_a")).alias("a"), F.col("top.n").alias("n"))
