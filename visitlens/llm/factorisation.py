"""Quality classifier: a factorisation machine on hashed words, structure and size.

``logit = b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j``. The pair sum of
all inputs of a text is half of (sum of v x) squared less the sum of (v x)
squared, per factor, so a text is scored in time linear in its different words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import mapped, whole

STRUCTURE = ("bias_words", "log_words", "word_length", "symbols", "marked_words", "upper", "distinct_words",
             "commonest_word", "repeated_pairs", "duplicate_lines", "line_length", "digits", "stops", "exclaims",
             "stored_size")


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows a model is fitted on (those with the
    least hash of their id); ``buckets`` and ``factors`` bound the model's size."""

    most_rows: int = 8000
    buckets: int = 1 << 14
    factors: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def structure(text: bytes, words: list[bytes], counts: Counter, stored: float) -> list[float]:
    """One number per name of ``STRUCTURE``; none depends on labels, language, source or id."""
    n = len(words) or 1
    letters = sum(map(len, words)) or 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    marked = sum(not w[-1:].isalpha() and w[-1] < 128 for w in words)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [1.0, np.log1p(len(words)), letters / n, symbols / n, marked / n, upper / letters, len(counts) / n,
            max(counts.values(), default=0) / n, 1 - pairs / max(n - 1, 1) if len(words) > 1 else 0.0,
            1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(len(text) / max(len(lines), 1)), digits / letters,
            text.count(b".") / n, text.count(b"!") / n, stored]


def inputs(text: bytes, n_chars: int | None, buckets: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and values of the words (length one in all), and the structure numbers."""
    raw = text.split()
    counts = Counter(text.lower().split())
    at = np.fromiter((zlib.crc32(w) for w in counts), np.int64, len(counts)) % buckets
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    # Words that share a bucket are one input.
    which, place = np.unique(at, return_inverse=True)
    x = np.bincount(place, value, len(which)) if len(which) else np.zeros(0)
    size = np.sqrt((x * x).sum()) or 1.0
    return which, x / size, structure(text, raw, counts, np.log1p(max(n_chars or 0, 0)))


def logits(model: Model, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
    """Scores before the sigmoid, all texts of a batch at once."""
    idx, val, ptr = _flat(model, rows)
    return _forward(model.bias, model.weights, model.factors, idx, val, ptr)[0]


def _flat(model: Model, rows):
    n = len(model.weights) - len(STRUCTURE)
    dense = (np.array([r[2] for r in rows]).reshape(-1, len(STRUCTURE)) - model.centre) / model.scale
    dense = np.clip(dense, -6, 6) / np.sqrt(len(STRUCTURE))
    idx = np.concatenate([np.concatenate((r[0], np.arange(n, n + len(STRUCTURE)))) for r in rows])
    val = np.concatenate([np.concatenate((r[1], d)) for r, d in zip(rows, dense, strict=True)])
    ptr = np.cumsum([0, *(len(r[0]) + len(STRUCTURE) for r in rows)])[:-1]
    return idx, val, ptr


def _forward(bias, weights, factors, idx, val, ptr):
    vx = factors[idx] * val[:, None]
    sums = np.add.reduceat(vx, ptr)
    squares = np.add.reduceat(vx * vx, ptr)
    return bias + np.add.reduceat(weights[idx] * val, ptr) + 0.5 * (sums * sums - squares).sum(1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, s: Settings) -> Model:
    """AdaGrad on the log loss; both labels weigh alike on average over the prior given by the rows."""
    rng = np.random.default_rng(s.seed)
    dense = np.array([r[2] for r in rows]).reshape(-1, len(STRUCTURE))
    scale = dense.std(0)
    n = s.buckets + len(STRUCTURE)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    model = Model(float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.05, (n, s.factors)),
                  dense.mean(0) if len(rows) else np.zeros(len(STRUCTURE)),
                  np.where(scale > 1e-9, scale, 1.0) if len(rows) else np.ones(len(STRUCTURE)))
    if not len(rows) or labels.min() == labels.max():
        return model
    bias, w, v = model.bias, model.weights, model.factors
    gb, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, s.factors), 1e-6)
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), s.batch):
            pick = order[at:at + s.batch]
            idx, val, ptr = _flat(model, [rows[i] for i in pick])
            z, sums = _forward(bias, w, v, idx, val, ptr)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            lengths = np.diff(np.append(ptr, len(idx)))
            e = np.repeat(err, lengths)
            slot, place = np.unique(idx, return_inverse=True)
            dw = np.bincount(place, e * val, len(slot)) + s.decay * w[slot]
            each = (np.repeat(sums, lengths, 0) - v[idx] * val[:, None]) * (e * val)[:, None]
            dv = np.zeros((len(slot), s.factors))
            np.add.at(dv, place, each)
            dv += s.decay * v[slot]
            gb += err.sum() ** 2
            gw[slot] += dw * dw
            gv[slot] += dv * dv
            bias -= s.rate * err.sum() / np.sqrt(gb)
            w[slot] -= s.rate * dw / np.sqrt(gw[slot])
            v[slot] -= s.rate * dv / np.sqrt(gv[slot])
    return Model(float(bias), w, v, model.centre, model.scale)


def held_out_flag(doc_id: Column, of: int = 4, at: int = 2) -> Column:
    """Rows kept from training; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == at


def _texts(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.char_length(whole()).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().cast("binary").alias("text"),
                       size.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from at most ``most_rows`` labelled rows that are not held out.

    A label counts where ``quality`` is 0 or 1 and the id is not null; an id
    labelled twice counts once, by its greatest label. Without rows, or with one
    label only, the model knows but the prior.
    """
    some = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_flag(F.col("doc_id")))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_rows))
    # At most ``most_rows`` small rows are broadcast.
    rows = _texts(docs).join(F.broadcast(some), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [inputs(t.as_py(), c.as_py(), s.buckets) for t, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()),
                 pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary()),
                 pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                ["doc_id", "quality", "at", "value", "dense"])

    known = mapped(rows.select("doc_id", "text", "n_chars", "quality"), features,
                   "doc_id bigint, quality int, at binary, value binary, dense array<double>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort(key=lambda r: (r[0], r[2], r[3]))
        data = [(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(float), r[4])
                for r in found]
        m = fit(data, np.array([r[1] for r in found], float), s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), *(pa.array([x.astype("<f8").tobytes()], pa.binary())
                                   for x in (m.weights, m.factors, m.centre, m.scale))],
            ["bias", "weights", "factors", "centre", "scale"])

    # The bounded sample is fitted in one task.
    m = mapped(known.repartition(1), learn,
               "bias double, weights binary, factors binary, centre binary, scale binary").first()
    if m is None:
        return fit([], np.zeros(0), s)
    of = lambda x: np.frombuffer(bytes(x), "<f8")
    return Model(m["bias"], of(m["weights"]), of(m["factors"]).reshape(-1, s.factors), of(m["centre"]), of(m["scale"]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    A null or empty text has no words and is scored by its structure. Repeated rows give
    repeated results, an empty table none. ``doc_id``, ``text`` and, where there is one,
    ``n_chars`` are read; a null ``n_chars`` counts as 0.
    """
    buckets = len(model.weights) - len(STRUCTURE)

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                z = logits(model, [inputs(t.as_py(), c.as_py(), buckets)
                                   for t, c in zip(part.column(1), part.column(2), strict=True)])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(p),
                                                  pa.array((p >= threshold).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return mapped(_texts(docs).withColumn("held_out", held_out_flag(F.col("doc_id"))), batches,
                  "doc_id bigint, held_out boolean, score double, predicted int")
