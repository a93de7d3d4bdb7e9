"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. A field over the tokens that could be personal
(those with a digit, ``@`` or ``=``) adds the ones patterns miss: neighbours in the text
are linked in a chain, and occurrences of the same or a similar token anywhere in the
document share a potential, each with the next one, so that one occurrence with
clear surroundings decides for the bare ones. Labels come from loopy message
passing over the whole document. The field is trained on what the patterns find.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import mapped, whole

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Label 0 is no personal data.
LABELS = ("none", *KINDS)

SPACE = " \t\n\x0b\x0c\r"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that started within a run of digits would also start with the run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@=]")
BREAK = re.compile(r"[\x20\x09-\x0D]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ASSIGNED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key)\W{0,4}$", re.IGNORECASE)
HINTS = tuple(re.compile(rf"(?:{x})\W{{0,4}}$", re.IGNORECASE) for x in (
    "password|passwd|pwd|secret|token|api[_-]?key|key", "tel|phone|call|fax|mobile", "mail|e-mail|contact",
    "card|visa|credit|iban", "ip|host|server|address", "version|license|page|chapter|year|cc by-nc"))


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the documents the field is trained on (least hash of id)."""

    most_rows: int = 4000
    rounds: int = 8
    steps: int = 300
    least_certain: float = 0.9


@dataclass(frozen=True)
class Field:
    """``node`` scores features by label, ``chain`` and ``skip`` score pairs of labels."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outward, so that long runs cost no retries."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            # The characters before this sign can't be part of a later match's local part.
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans per kind of ``BASE_KINDS``; a match that fails its check is dropped, not retried."""
    out: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out[3].append(m.span())
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens that could be personal, without quotes and marks around them or a key before them."""
    out, free = [], 0
    m = CANDIDATE.search(text)
    while m:
        start = m.start()
        while start > free and text[start - 1] not in SPACE:
            start -= 1
        stop = BREAK.search(text, m.end())
        end = stop.start() if stop else len(text)
        free = end
        a, b = start, end
        cut = max(text.rfind("=", a, b), text.rfind('"', a, b - 1))
        if a <= cut < b - 1:
            a = cut + 1
        while a < b and text[a] in "\"'([{<":
            a += 1
        while a < b and text[b - 1] in ".,;:!?\"')]}>":
            b -= 1
        if a < b:
            out.append((a, b))
        m = CANDIDATE.search(text, end)
    return out


FEATURES = 40


def features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that hold for a token."""
    core = text[a:b]
    digits = NOT_DIGIT.sub("", core)
    n, size = len(digits), b - a
    out = [0, 1 + min((0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5)[n] if n < 20 else 6, 6)]
    out.append(8 + (0 if not n else 1 if 2 * n < size else 2 if n < size else 3))
    out.append(12 + min(size // 8, 5))
    if "@" in core:
        out.append(18)
    dots = core.count(".")
    if dots:
        out.append(19 + min(dots, 3))
    if "-" in core:
        out.append(23)
    if core[0] == "+":
        out.append(24)
    if a and text[a - 1] == "(":
        out.append(25)
    if size >= 12 and core.isalnum() and 0 < n < size:
        out.append(26)
        if all(c in "0123456789abcdefABCDEF" for c in core):
            out.append(27)
    if n == size == 4 and core[:2] in ("19", "20"):
        out.append(28)
    if 16 <= n <= 19 and luhn(digits):
        out.append(29)
    before = text[max(0, a - 24):a]
    for i, hint in enumerate(HINTS):
        if hint.search(before):
            out.append(30 + i)
    if a and text[a - 1] in "=\"":
        out.append(36)
    return out


def edges(text: str, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain links of close neighbours, and links of each token to the next same or similar one."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 4]
    last: dict[tuple[str, str], int] = {}
    skip = []
    for i, (a, b) in enumerate(found):
        core = text[a:b].lower()
        digits = NOT_DIGIT.sub("", core)
        keys = {("same", core)}
        if len(digits) >= 7:
            keys.add(("digits", digits[-7:]))
        if "@" in core:
            keys.add(("name", core.split("@")[0]))
        elif len(core) >= 5:
            keys.add(("name", core))
        links = {last[k] for k in keys if k in last and len(core) > 2}
        skip += [(j, i) for j in links]
        last.update(dict.fromkeys(keys, i))
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def marginals(unary: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> np.ndarray:
    """Loopy sum-product: label probabilities per node, with ``(pairs, potential)`` links.

    All messages of a round are computed at once and damped by half.
    """
    pairs = [(p, w) for p, w in links if len(p)]
    if not pairs:
        return _softmax(unary)
    src = np.concatenate([np.concatenate((p[:, 0], p[:, 1])) for p, _ in pairs])
    dst = np.concatenate([np.concatenate((p[:, 1], p[:, 0])) for p, _ in pairs])
    weight = np.concatenate([np.concatenate((np.repeat(w[None], len(p), 0), np.repeat(w.T[None], len(p), 0)))
                             for p, w in pairs])
    back = np.concatenate([at + np.concatenate((np.arange(len(p), 2 * len(p)), np.arange(len(p))))
                           for at, (p, _) in zip(np.cumsum([0, *(2 * len(p) for p, _ in pairs[:-1])]), pairs,
                                                 strict=True)])
    message = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = (belief[src] - message[back])[:, :, None] + weight
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, dst, message)
    return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _observed(found: list[tuple[int, int]], base: list[list[tuple[int, int]]]) -> np.ndarray:
    """Label of each token that overlaps a base span, else 0."""
    out = np.zeros(len(found), np.int64)
    starts = np.array([a for a, _ in found], np.int64)
    ends = np.array([b for _, b in found], np.int64)
    for kind, spans in enumerate(base, 1):
        for a, b in spans:
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            here = out[lo:hi]
            here[here == 0] = kind
    return out


def examples(text: str) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Features, silver labels, chain links and skip links of one training text."""
    found = nodes(text)
    labels = _observed(found, base_spans(text))
    for i, (a, b) in enumerate(found):
        if not labels[i] and b - a >= 10 and text[a:b].isalnum() and ASSIGNED.search(text[max(0, a - 24):a]):
            labels[i] = LABELS.index("secret")
    chain, skip = edges(text, found)
    return [features(text, a, b) for a, b in found], labels, chain, skip


def learn(texts: list[str], s: Settings) -> Field:
    """Node weights by the label likelihood of each token, pair scores by how labels meet."""
    k = len(LABELS)
    rows, labels = [], []
    pair = {"chain": np.full((k, k), 0.5), "skip": np.full((k, k), 0.5) + 20 * np.eye(k)}
    for text in texts:
        f, y, chain, skip = examples(text)
        rows += f
        labels.append(y)
        for name, p in (("chain", chain), ("skip", skip)):
            np.add.at(pair[name], (y[p[:, 0]], y[p[:, 1]]), 1)
            np.add.at(pair[name], (y[p[:, 1]], y[p[:, 0]]), 1)
    node = np.zeros((FEATURES, k))
    if rows:
        x = np.zeros((len(rows), FEATURES))
        for i, f in enumerate(rows):
            x[i, f] = 1
        y = np.concatenate(labels)
        # Equal rows are one row with a weight.
        unique, times = np.unique(np.column_stack((x, y)), axis=0, return_counts=True)
        x, y, times = unique[:, :-1], unique[:, -1].astype(int), times / times.sum()
        first, second = np.zeros_like(node), np.zeros_like(node)
        for t in range(1, s.steps + 1):
            error = _softmax(x @ node)
            error[np.arange(len(y)), y] -= 1
            grad = x.T @ (error * times[:, None]) + 1e-4 * node
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            node -= 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    def ratio(m):
        return np.clip(np.log(m * m.sum() / np.outer(m.sum(1), m.sum(0))), -2.0, 2.0)

    return Field(node, ratio(pair["chain"]), ratio(pair["skip"]))


def train(docs: DataFrame, s: Settings = Settings()) -> Field:
    """A field from at most ``most_rows`` texts with a candidate token; bounded, so one task fits it."""
    some = (docs.filter(F.col("text").rlike("[0-9@=]")).select(
        F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text").orderBy("h").limit(s.most_rows))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, t) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                               strict=True))
        f = learn([t for _, t in rows], s)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (f.node, f.chain, f.skip)],
                                         ["node", "chain", "skip"])

    got = mapped(some.repartition(1), fit, "node binary, chain binary, skip binary").first()
    if got is None:
        return learn([], s)
    k = len(LABELS)
    return Field(*(np.frombuffer(bytes(got[c]), float).reshape(-1, k) for c in ("node", "chain", "skip")))


def find(text: str, field: Field, s: Settings) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans per base kind, and all spans per kind of ``KINDS``."""
    if not CANDIDATE.search(text) and "+" not in text:
        return [[], [], [], []], [[] for _ in KINDS]
    base = base_spans(text)
    out = [list(b) for b in base] + [[]]
    found = nodes(text)
    if not found:
        return base, out
    seen = _observed(found, base)
    unary = np.array([field.node[f].sum(0) for f in (features(text, a, b) for a, b in found)])
    fixed = seen > 0
    unary[fixed, seen[fixed]] += 12.0
    chain, skip = edges(text, found)
    p = marginals(unary, [(chain, field.chain), (skip, field.skip)], s.rounds)
    label = p.argmax(1)
    sure = (p[np.arange(len(p)), label] >= s.least_certain) & ~fixed & (label > 0)
    previous = None
    for i in np.flatnonzero(sure).tolist():
        a, b = found[i]
        kind = label[i] - 1
        # Neighbours of one kind are one span, as a number may be written in groups.
        if previous == (i - 1, kind) and a - out[kind][-1][1] <= 2:
            out[kind][-1] = (out[kind][-1][0], b)
        else:
            out[kind].append((a, b))
        previous = (i, kind)
    return base, [sorted(x) for x in out]


def _line(kinds: tuple[str, ...], spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in zip(kinds, spans, strict=True) for a, b in found)


def scan(docs: DataFrame, field: Field, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row.

    Spans are in code points, the end exclusive. A null or empty text has none.
    Repeated rows give repeated results, an empty table none. Only ``doc_id`` and
    ``text`` are read.
    """

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            rows = []
            for t in b.column(1):
                base, every = find(t.as_py(), field, s)
                rows.append((*map(len, base), hashlib.sha256(_line(BASE_KINDS, base).encode()).hexdigest(),
                             _line(KINDS, every)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")), batches,
                  "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                  "base_sha256 string, spans string")


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are one, named after the first."""
    flat = sorted((a, b, k) for k, found in zip(KINDS, spans, strict=True) for a, b in found)
    out, at = [], 0
    for a, b, k in flat:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, s: Settings = Settings()) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars``, where there is one, set
    for the texts that changed; null texts stay null, other columns stay as they are."""
    names = docs.columns

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [t if not t else masked(t, find(t, field, s)[1]) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                c = b.schema.get_field_index("n_chars")
                cols[c] = pa.array([n if x == y else len(y) for x, y, n in zip(old, new, cols[c].to_pylist(),
                                                                                strict=True)], b.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return mapped(docs, batches, docs.schema)
