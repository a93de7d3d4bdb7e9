"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a vocabulary and their log probabilities span a lattice over the text. The
vocabulary is one of merges, whose own scores are ranks and say nothing about how likely a piece is;
so the probabilities are learned from the documents (:func:`train`): the pieces of the library's own
segmentation are counted over all of them. Texts are taken as they are; this vocabulary's model
normalises nothing but spaces, which become its space mark.

A forward pass gives the best score of a path from the start to every node. The
N-best search walks backward from the end: a partial path's own score plus the
forward score of the node it has reached is exactly the best total it can still get,
so an A-star search with that heuristic yields whole paths best first.

A node that no piece spans is on every path, so the lattice of a text falls into those
of its parts, cut wherever no piece holds the two letters that meet there: in front of
a space, and mostly between a word and its punctuation (:func:`borders`). A batch of texts is
cut at once and only its different parts are looked up. The best and second best
score of each part are found for many parts at once and remembered; the N best
of a text are the N best sums over its parts, and only the N - 1 parts that lose
least by their second choice can take part in them. Those are searched by A-star.
This is exact.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import by_bytes, flat, mapped, told_apart, whole

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Below this a score means "never by merging"; such pieces are left out of the lattice.
LEAST_SCORE = -1e8
UNKNOWN_PENALTY = 10.0
#: Added to each piece's count, so that a piece never seen has a small probability.
ADD = 0.5
GRID = 2.0 ** 24
#: A letter of no piece but its byte, between parts that are segmented in one call, and how many these are.
BETWEEN, IN_ONE_CALL = "\x01", 2000
#: Words of one length that are solved together at least, and up to which length.
ALIKE, LONGEST_ALIKE = 100, 40
#: A text with a space in front falls into these: no piece goes from another letter on to a space.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class Lattice:
    """Pieces of one vocabulary with their log probabilities, and the segmentations of texts into them.

    ``counts``: how often each id was seen. Up to twice ``most_words`` solved words are remembered.
    """

    def __init__(self, path: str, counts: np.ndarray, most_words: int = 200_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        # A letter that is never made by merging still stands for itself.
        used = [i for i in range(model.vocab_size()) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
            and (model.get_score(i) > LEAST_SCORE or len(self.pieces[i]) == 1)]
        seen = np.asarray(counts, np.float64)[used] + ADD
        # Whole multiples of a small power of two, so that sums are exact in any order.
        scores = np.round((np.log(seen) - np.log(seen.sum())) * GRID) / GRID
        self.scores = {self.pieces[i]: (score, i) for i, score in zip(used, scores.tolist(), strict=True)}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError(f"{path}: pieces go on behind a space")
        least = min(score for score, _ in self.scores.values())
        self.longest = max(map(len, self.scores))
        self.unknown = least - UNKNOWN_PENALTY
        self.decoded = bytes_of_ids(model)
        self.decoded_table = pa.array(self.decoded, pa.large_binary())
        self.borders = borders(model)
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
        self.most_words = most_words
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.old: dict[str, tuple[bytes, float, float]] = {}
        self.tops: dict[str, list[float]] = {}
        self._build()

    def _build(self) -> None:
        """The pieces as a tree: sorted keys of (node, letter), the child of each, the piece at each node."""
        children: dict[tuple[int, int], int] = {}
        ends = {}
        for piece, (_, i) in self.scores.items():
            node = 0
            for c in piece:
                node = children.setdefault((node, ord(c)), len(children) + 1)
            ends[node] = i
        keys = np.array([n << 21 | c for n, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.at_node = np.full(len(children) + 1, -1, np.int64)
        self.at_node[list(ends)] = list(ends.values())
        self.score_of = np.zeros(len(self.pieces))
        for score, i in self.scores.values():
            self.score_of[i] = score

    def _ids(self, piece: str) -> list[int]:
        return [self.scores[piece][1]] if piece in self.scores else [self.bytes[b] for b in piece.encode()]

    def edges(self, word: str) -> list[list[tuple[int, float]]]:
        """Per node the pieces that end there: start and score. A letter of no piece is one edge of bytes."""
        n, scores = len(word), self.scores
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, min(start + self.longest, n) + 1):
                got = scores.get(word[start:end])
                if got:
                    out[end].append((start, got[0]))
            if word[start] not in scores:
                out[start + 1].append((start, self.unknown))
        return out

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (fewer if there are fewer), best first; ties in a fixed order."""
        edges = self.edges(word)
        best = [0.0] * len(edges)
        for node in range(1, len(edges)):
            best[node] = max(best[start] + score for start, score in edges[node])
        serial, done = 0, []
        # (minus the best total, node reached, serial, own score, cuts so far). Of equal totals
        # the one nearest to the start goes first, so ties don't widen the search.
        agenda = [(-best[-1], len(word), 0, 0.0, None)]
        while agenda and len(done) < n:
            _, node, _, own, cuts = heapq.heappop(agenda)
            if node == 0:
                found, at = [], cuts
                while at is not None:
                    found.append(at[0])
                    at = at[1]
                done.append((own, [i for a, b in zip(found, [*found[1:], len(word)], strict=True)
                                   for i in self._ids(word[a:b])]))
                continue
            for start, score in edges[node]:
                serial += 1
                heapq.heappush(agenda, (-(own + score + best[start]), start, serial, own + score, (start, cuts)))
        return done

    def _walk(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of letters in a row: start, end and id (-1: a letter of no piece); ``stop`` ends each's word."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        starts, ends, ids = [], [], []
        for depth in range(self.longest):
            inside = at + depth < stop[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            key = node << 21 | codes[at + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, node = at[hit], self.child[i[hit]]
            whole_piece = self.at_node[node] >= 0
            starts.append(at[whole_piece])
            ends.append(at[whole_piece] + depth + 1)
            ids.append(self.at_node[node[whole_piece]])
            if not depth:
                alone = np.setdiff1d(np.arange(len(codes)), starts[0], assume_unique=True)
                starts.append(alone)
                ends.append(alone + 1)
                ids.append(np.full(len(alone), -1))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)

    def solve(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """Per word the ids of the best path, its score, and what the second best path loses.

        All lattices at once, node by node from the words' starts. The second best is the best
        path through any edge off the best one, by forward and backward scores.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        word_of = np.repeat(np.arange(len(words)), sizes)
        start, end, ids = self._walk(codes, np.repeat(first + sizes, sizes))
        score = np.where(ids >= 0, self.score_of[ids], self.unknown)
        word = word_of[start]
        # Every word has a node more than letters.
        a, b = start + word, end + word
        begin, last = first + np.arange(len(words)), first + sizes + np.arange(len(words))
        forward, through = self._sweep(a, b, score, end - first[word], begin, len(codes) + len(words))
        backward, _ = self._sweep(b, a, score, first[word] + sizes[word] - start, last, len(codes) + len(words))
        used = np.zeros(len(a), bool)
        node, left = last, begin
        while len(node):
            edge = through[node]
            used[edge] = True
            node = a[edge]
            go = node > left
            node, left = node[go], left[go]
        second = np.full(len(words), -np.inf)
        off = ~used
        np.maximum.at(second, word[off], forward[a[off]] + score[off] + backward[b[off]])
        path = np.flatnonzero(used)
        path = path[np.argsort(a[path])]
        bounds = np.searchsorted(word[path], np.arange(len(words) + 1)).tolist()
        body = ids[path].astype("<u4").tobytes()
        plain = np.ones(len(words), bool)
        plain[word[path[ids[path] < 0]]] = False
        out = [(body[4 * p:4 * q], s, loss) for p, q, s, loss in
               zip(bounds, bounds[1:], forward[last].tolist(), (forward[last] - second).tolist(), strict=False)]
        for i in np.flatnonzero(~plain).tolist():
            each = path[bounds[i]:bounds[i + 1]]
            got = [x for e in each.tolist() for x in (
                [int(ids[e])] if ids[e] >= 0 else self._ids(chr(codes[start[e]])))]
            out[i] = (np.array(got, "<u4").tobytes(), *out[i][1:])
        return out

    def _solve_equal(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """As :meth:`solve`, for many words of one length: every node is a column of all words."""
        n, width = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64).reshape(width, n)
        # Score and id of the piece from each start, by its length; what is no piece is never taken.
        start, end, ids = self._walk(codes.ravel(), np.repeat(np.arange(1, width + 1) * n, n))
        row, first = np.divmod(start, n)
        size = end - start
        most = int(size.max())
        score = np.full((most, n, width), -np.inf)
        piece = np.full((most, n, width), -1, np.int64)
        score[size - 1, first, row] = np.where(ids >= 0, self.score_of[ids], self.unknown)
        piece[size - 1, first, row] = ids
        forward, backward = np.full((n + 1, width), -np.inf), np.full((n + 1, width), -np.inf)
        through = np.zeros((n + 1, width), np.int64)
        forward[0] = backward[n] = 0.0
        for at in range(1, n + 1):
            # Of equal paths the one whose last piece starts first.
            for k in range(min(at, most), 0, -1):
                value = forward[at - k] + score[k - 1, at - k]
                better = value > forward[at]
                forward[at][better] = value[better]
                through[at][better] = k
        for at in range(n - 1, -1, -1):
            for k in range(1, min(n - at, most) + 1):
                np.maximum(backward[at], score[k - 1, at] + backward[at + k], out=backward[at])
        used = np.zeros((most, n, width), bool)
        path = np.full((n, width), -2, np.int64)
        at, every = np.full(width, n), np.arange(width)
        while True:
            live = every[at > 0]
            if not len(live):
                break
            k = through[at[live], live]
            at[live] -= k
            used[k - 1, at[live], live] = True
            path[at[live], live] = piece[k - 1, at[live], live]
        score[used] = -np.inf
        second = np.full(width, -np.inf)
        for at in range(1, n + 1):
            for k in range(1, min(at, most) + 1):
                np.maximum(second, forward[at - k] + score[k - 1, at - k] + backward[at], out=second)
        path = path.T
        taken = path != -2
        cuts = [0, *(4 * np.cumsum(taken.sum(1))).tolist()]
        body = path[taken].astype("<u4").tobytes()
        best = forward[n].tolist()
        loss = (forward[n] - second).tolist()
        out = [(body[p:q], b, x) for p, q, b, x in zip(cuts, cuts[1:], best, loss, strict=False)]
        for i in np.flatnonzero((path == -1).any(1)).tolist():
            got = [x for j, e in enumerate(path[i].tolist()) if e != -2
                   for x in ([e] if e >= 0 else self._ids(words[i][j]))]
            out[i] = (np.array(got, "<u4").tobytes(), *out[i][1:])
        return out

    @staticmethod
    def _sweep(a, b, score, step, begin, nodes) -> tuple[np.ndarray, np.ndarray]:
        """Best score from ``begin`` to each node along edges a to b, and the edge it comes by.

        ``step`` is how far b lies from its word's beginning; nodes of one step are done at once.
        """
        best, through = np.full(nodes, -np.inf), np.full(nodes, -1, np.int64)
        best[begin] = 0.0
        order = np.lexsort((a, b, step))
        a, b, score, step = a[order], b[order], score[order], step[order]
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=np.iinfo(np.int64).max))
        for p, q in zip(cuts, cuts[1:], strict=False):
            value = best[a[p:q]] + score[p:q]
            group = np.flatnonzero(np.diff(b[p:q], prepend=-1))
            top = np.maximum.reduceat(value, group)
            to = b[p:q][group]
            best[to] = top
            equal = np.flatnonzero(value == np.repeat(top, np.diff(np.append(group, q - p))))
            where = np.searchsorted(equal, group)
            through[to] = order[p + equal[where]]
        return best, through

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[bytes, float, float]]:
        """Solutions of every word of some texts; words lately seen are remembered."""
        if len(self.known) > self.most_words:
            self.known, self.old = {}, self.known
        known, old, missing = self.known, self.old, []
        for w in set(chain.from_iterable(texts)):
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        missing.sort(key=len)
        # Most words share their length with many others and are done column by column.
        of_length, rest = defaultdict(list), []
        for w in missing:
            of_length[len(w)].append(w)
        for n, words in of_length.items():
            if len(words) < ALIKE or n > LONGEST_ALIKE:
                rest += words
                continue
            few = 150_000 // n
            for i in range(0, len(words), few):
                self.known.update(zip(words[i:i + few], self._solve_equal(words[i:i + few]), strict=True))
        missing, at = rest, 0
        while at < len(missing):
            upto, letters = at, 0
            while upto < len(missing) and (upto == at or letters + len(missing[upto]) <= 100_000):
                letters += len(missing[upto])
                upto += 1
            self.known.update(zip(missing[at:upto], self.solve(missing[at:upto]), strict=True))
            at = upto
        return self.known

    def encode(self, texts: list[str] | pa.Array, n: int = 1
               ) -> list[tuple[bytes, list[float], list[list[tuple[str, int]]]]]:
        """Per text the ids of the best segmentation, the n best scores, and per score the parts
        that differ from the best, with the rank of their segmentation.

        A space becomes the space mark and one more is put in front; no text, no pieces.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        parts, which, bounds = parts_of(texts, self.borders)
        if not len(parts):
            return [(b"", [0.0], [[]])] * len(texts)
        known = self.learn([parts])
        bodies, scores, losses = zip(*map(known.__getitem__, parts), strict=True)
        ids, places = flat(pa.array(bodies, pa.large_binary()).take(pa.array(which)))
        cuts = places[bounds].tolist()
        # Sums are exact, so the difference of two is.
        sums = np.concatenate([[0.0], np.cumsum(np.array(scores)[which])])[bounds]
        lost, bounds, out = np.array(losses)[which], bounds.tolist(), []
        for p, q, a, b, best in zip(cuts, cuts[1:], bounds, bounds[1:], np.diff(sums).tolist(), strict=False):
            body = ids[p:q].tobytes()
            if n == 1 or a == b:
                out.append((body, [best], [[]]))
                continue
            loss = lost[a:b]
            # Only the n - 1 parts that lose least by their second choice can be in the n best.
            least = np.argpartition(loss, n - 2)[:n - 1] if len(loss) > n - 1 else np.arange(len(loss))
            least = sorted((x, i) for x, i in zip(loss[least].tolist(), least.tolist(), strict=True) if x < np.inf)
            got, choices = _best_sums([(parts[which[a + i]], x) for x, i in least], n, lambda w: self._top(w, n))
            out.append((body, [best - x for x in got], choices))
        return out

    def _top(self, word: str, n: int) -> list[float]:
        if (word, n) not in self.tops:
            if len(self.tops) > 20_000:
                self.tops.clear()
            self.tops[word, n] = [s for s, _ in self.n_best(word, n)]
        return self.tops[word, n]

    def decode(self, ids: bytes) -> str:
        """The text of ids; inverse of ``encode`` for every text without the space mark."""
        return joined(self.decoded, ids)

    def decode_all(self, bodies: list[bytes]) -> list[bytes]:
        """As :meth:`decode`, for many texts at once, in UTF-8."""
        ids = np.frombuffer(b"".join(bodies), "<u4")
        data, places = flat(self.decoded_table.take(pa.array(ids)))
        cuts = places[np.cumsum([0, *map(len, bodies)]) // 4].tolist()
        out = [data[p:q].tobytes() for p, q in zip(cuts, cuts[1:], strict=False)]
        return [x[1:] if x[:1] == b" " else x for x in out]


def words_of(text: str) -> list[str]:
    """Words of a text, each with the space marks in front of it."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def borders(model: sentencepiece.SentencePieceProcessor) -> np.ndarray:
    """For each two bytes, as a number of 16 bits, whether a letter ends and another begins
    between them and no piece goes on from one to the other. Spaces stand for their mark."""
    out = np.ones((256, 256), bool)
    out[:, 0x80:0xC0] = False
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            letters = np.frombuffer(model.id_to_piece(i).replace(SPACE, " ").encode(), np.uint8)
            out[letters[:-1], letters[1:]] = False
    return out.ravel()


def parts_of(texts: pa.Array, cut: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different parts of some texts, which of them stand in a row in all texts together, and
    the number of parts before each text and behind the last. ``cut``: see :func:`borders`."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
    marked = pc.binary_join_element_wise(*(x if x is texts else pa.scalar(x, texts.type) for x in ("", texts, " ")))
    data, offsets = flat(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked))
    if not len(data):
        return [], np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    first = np.ones(len(data), bool)
    first[1:] = cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    parts, which = told_apart(data, starts)
    parts = pc.replace_substring(parts.cast(pa.large_string()), " ", SPACE)
    return parts.to_numpy(zero_copy_only=False).tolist(), which, np.searchsorted(starts, offsets)


def bytes_of_ids(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    pieces = map(model.id_to_piece, range(model.vocab_size()))
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)]


def joined(table: list[bytes], ids: bytes) -> str:
    text = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


def _best_sums(parts: list[tuple[str, float]], n: int, top: Callable[[str], list[float]]
               ) -> tuple[list[float], list[list[tuple[str, int]]]]:
    """The n least total losses over one choice per part, least first, with the parts not at their best.

    ``parts``: a word and what its second choice loses. Further choices are searched only when a sum
    with the one before them is among the n least.
    """
    found: dict[int, list[float]] = {}

    def loss(i: int, rank: int) -> float | None:
        if rank < 2:
            return rank * parts[i][1]
        if i not in found:
            scores = top(parts[i][0])
            found[i] = [scores[0] - x for x in scores]
        return found[i][rank] if rank < len(found[i]) else None

    start = (0,) * len(parts)
    agenda, seen, out = [(0.0, start)], {start}, []
    while agenda and len(out) < n:
        total, at = heapq.heappop(agenda)
        out.append((total, [(parts[i][0], r) for i, r in enumerate(at) if r]))
        if len(out) == n:
            break
        for i, r in enumerate(at):
            more = loss(i, r + 1)
            nxt = (*at[:i], r + 1, *at[i + 1:])
            if more is not None and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(agenda, (sum(loss(j, x) for j, x in enumerate(nxt)), nxt))
    return [x for x, _ in out], [c for _, c in out]


def train(docs: DataFrame, vocabulary: str = VOCABULARY, most_words: int = 200_000) -> np.ndarray:
    """How often each id of the vocabulary is in the library's own segmentation of all texts.

    No piece crosses the borders of parts, so parts are counted first and each different one of
    a stretch is segmented once. A task sends a row per id, and the result has the
    vocabulary's length. Null and empty texts count nothing; an empty table gives zeros.
    """
    size = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary)).vocab_size()

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        total, cut, between = np.zeros(size, np.int64), borders(model), model.encode(BETWEEN)[-1]
        found = [pa.table({"part": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})]
        held = 0

        def merged() -> pa.Table:
            return pa.concat_tables(found).group_by("part").aggregate([("n", "sum")]).rename_columns(["part", "n"])

        def add() -> None:
            counted = merged()
            parts, many = counted["part"].to_pylist(), counted["n"].to_numpy()
            for at in range(0, len(parts), IN_ONE_CALL):
                some_parts, n = parts[at:at + IN_ONE_CALL], many[at:at + IN_ONE_CALL]
                if BETWEEN in some_parts:
                    i = some_parts.index(BETWEEN)
                    total[between] += n[i]
                    some_parts, n = some_parts[:i] + some_parts[i + 1:], np.delete(n, i)
                if not some_parts:
                    continue
                # The library puts a space in front by itself.
                ids = np.array(model.encode(BETWEEN + BETWEEN.join(some_parts) + BETWEEN, num_threads=1))[1:]
                own = ids != between
                part = np.cumsum(~own)[own] - 1
                if len(ids) - own.sum() != len(some_parts) + 1:
                    raise ValueError(f"{vocabulary}: a piece goes on behind a border")
                total[:] += np.bincount(ids[own], n[part], size).astype(np.int64)
            del found[1:]

        for b in some:
            for batch in by_bytes(b, 0):
                parts, which, _ = parts_of(batch.column(0), cut)
                found.append(pa.table({"part": pa.array(parts, pa.large_string()),
                                       "n": np.bincount(which, minlength=len(parts))}))
                held += len(parts)
                if held > most_words:
                    found[1:] = [merged()]
                    held = found[1].num_rows
                    if 2 * held > most_words:
                        add()
                        held = 0
        add()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = mapped(docs.select(whole().alias("text")), batches, "id bigint, n bigint")
    got = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, counts: np.ndarray) -> Lattice:
    """One lattice per worker process, for the counts asked for last."""
    key = path, zlib.crc32(counts.tobytes())
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(path, counts)
    return _LATTICES[key]


def encode(docs: DataFrame, counts: np.ndarray, n: int = 4, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs``' ``doc_id`` with ``ids`` (little-endian unsigned 32-bit), ``scores`` of the n best
    segmentations, best first, and ``changes``: per segmentation the parts that differ from the best
    and the rank of what they take. ``counts`` come from :func:`train`.

    A null or empty text has no pieces and one segmentation of score 0. Ties keep a
    fixed order. Repeated rows give repeated results, an empty table none. Only
    ``doc_id`` and ``text`` are read.
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(public_tokenizers.path(vocabulary), counts)
        for b in some:
            for part in by_bytes(b):
                got = of.encode(part.column(1), n)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([g[0] for g in got], pa.binary()),
                    pa.array([g[1] for g in got], pa.list_(pa.float64())),
                    pa.array([[[{"part": p, "rank": r} for p, r in c] for c in g[2]] for g in got],
                             pa.list_(pa.list_(pa.struct([("part", pa.string()), ("rank", pa.int32())]))))],
                    ["doc_id", "ids", "scores", "changes"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")), batches,
                  "doc_id bigint, ids binary, scores array<double>, "
                  "changes array<array<struct<part:string,rank:int>>>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of_ids(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary)))
        for b in some:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([joined(table, x.as_py() or b"") for x in part.column(1)], pa.string())],
                    ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), batches, "doc_id bigint, text string")


def digests(docs: DataFrame, counts: np.ndarray, n: int = 4, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, best_score, nbest_scores, round_trip`` of each row.

    ``round_trip``: decoding the ids gives the text back (a space mark in a
    text comes back as a space).
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(public_tokenizers.path(vocabulary), counts)
        for b in (part for whole_batch in some for part in by_bytes(whole_batch)):
            got = of.encode(b.column(1), n)
            texts = pc.replace_substring(b.column(1), SPACE, " ").cast(pa.binary()).to_pylist()
            back = of.decode_all([ids for ids, _, _ in got])
            rows = [(len(ids) // 4, zlib.crc32(ids), scores[0], scores,
                     own == t or own.decode("utf-8", "replace") == t.decode())
                    for t, own, (ids, scores, _) in zip(texts, back, got, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.float64())),
                 pa.array(cols[4], pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "best_score", "nbest_scores", "round_trip"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")), batches,
                  "doc_id bigint, n_pieces bigint, ids_crc32 bigint, best_score double, "
                  "nbest_scores array<double>, round_trip boolean")
