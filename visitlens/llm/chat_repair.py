"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation alternates user and assistant, with at most one system row in
front. Each row is kept, given another role or deleted, and empty rows may be inserted,
each at a cost. The search goes depth first through the edits in ASCII order
(D, I, K, R) under a cost bound that rises to the least cost seen beyond it; a
table keeps, for each failed state, what it would have needed at least. The first
accepting path is the cheapest repair and, of equal ones, the least as text.

How long conversations are split. Rows are range-partitioned in reading order, so the
rows of one conversation lie in a row, possibly in several partitions. They are cut
into segments of ``segment`` rows, and each is searched from every state before it to
every state behind it. Costs from there to the end follow from the segments' cost tables
alone, last to first; with them, each segment's edits are chosen first to last. A
segment's edits end with a row's edit (inserted rows go before a row), so no two
candidates are a prefix of each other and the least text of the whole is made of
the least texts of the parts. Only the last step passes through a whole conversation in
one task, as one hash and one list of edits per conversation are asked for; it holds one
segment and the edits so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import mapped, staged

FILLED = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
#: What a conversation so far ends with.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a user or assistant row that fits behind each state, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Cost of what must still be inserted behind the last row.
CLOSING = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Settings:
    """``segment``: rows searched at once. A conversation of more than ``most_rows`` rows or
    ``most_bytes`` of text is put together in a task of its own."""

    segment: int = 128
    most_rows: int = 4096
    most_bytes: int = 16 << 20


class Search:
    """Cheapest edits of some rows, given as (initial of the role, fault)."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows
        n = len(rows)
        # At least to be paid from row i on: behind the first row a system row can't be kept.
        self.least, self.least_at_start = [0] * (n + 1), [0] * (n + 1)
        system = 0
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            self.least[i] = self.least[i + 1] + (DELETE if fault else 0 if initial in ("u", "a") else REROLE)
            system = system or (not fault and initial == "s")
            self.least_at_start[i] = self.least[i] - system

    def reachable(self, entry: int, exit_: int) -> bool:
        if exit_ == START:
            return entry == START
        if exit_ == SYSTEM:
            return entry == SYSTEM or entry == START and any(
                initial == "s" and fault not in ("b", "d") for initial, fault in self.rows)
        return True

    def best(self, entry: int, exit_: int | None, table: dict | None = None) -> tuple[int, str] | None:
        """Cost and edits from state ``entry`` to ``exit_``, or to the end of the conversation (None)."""
        if exit_ is not None and not self.reachable(entry, exit_):
            return None
        table = {} if table is None else table
        bound = self._need(0, entry, table)
        while True:
            path: list[str] = []
            need = self._descend(0, entry, bound, exit_, table, path)
            if need is None:
                return bound, "".join(reversed(path))
            bound = need

    def _need(self, i: int, state: int, table: dict) -> int:
        known = table.get((i, state))
        return known if known is not None else (self.least_at_start if state == START else self.least)[i]

    def _descend(self, i: int, state: int, left: int, exit_: int | None, table: dict, path: list[str]) -> int | None:
        """None if an accepting path costs at most ``left`` (``path``: its edits, last first), else what is needed."""
        need = self._need(i, state, table)
        if need > left:
            return need
        if i == len(self.rows) and (state in (START, ASSISTANT) if exit_ is None else state == exit_):
            return None
        need = NEVER
        for edit, cost, j, after in self._edits(i, state, exit_ is None):
            got = self._descend(j, after, left - cost, exit_, table, path)
            if got is None:
                path.append(edit)
                return None
            need = min(need, cost + got)
        table[i, state] = need
        return need

    def _edits(self, i: int, state: int, open_end: bool) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: letter, cost, row and state behind it."""
        at_end = i == len(self.rows)
        if not at_end:
            yield "D", DELETE, i + 1, state
        if not at_end or open_end:
            yield "I", INSERT, i, NEXT[state]
        if at_end or self.rows[i][1] in ("b", "d"):
            return
        initial, fault = self.rows[i]
        extra = UNFINISHED if fault == "t" else 0
        if initial == "s" and state == START:
            yield "K", extra, i + 1, SYSTEM
        elif initial == ("a" if state == USER else "u"):
            yield "K", extra, i + 1, NEXT[state]
        yield "R", REROLE + extra, i + 1, NEXT[state]

    def table(self) -> tuple[list[int], list[str]]:
        """Cost and edits from every state to every state, row by row of a square table."""
        costs, edits = [NEVER] * 16, [""] * 16
        for exit_ in STATES:
            failed: dict = {}
            for entry in STATES:
                got = self.best(entry, exit_, failed)
                if got:
                    costs[4 * entry + exit_], edits[4 * entry + exit_] = got
        return costs, edits


#: A row in reading order: turn, role, text, fault ("b", "d", "t" or "").
Row = tuple[int | None, str, str, str]
RESULT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


class Conversation:
    """Counts, edits and hash of a conversation, taken in row by row."""

    def __init__(self):
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.turns = self.cost = 0
        self.low = self.high = None
        self.initial: str | None = None
        self.state, self.audit, self.hash, self.empty = START, [], hashlib.sha256(), True

    def add(self, rows: Iterable[Row], edits: str) -> None:
        """Rows and their edits; those behind the last row may be inserted rows only."""
        rows = iter(rows)
        for edit in edits:
            if edit == "I":
                self.state, self.cost = NEXT[self.state], self.cost + INSERT
                self._write(ROLE[self.state], "")
                continue
            turn, role, text, fault = next(rows)
            self._count(turn, role, fault)
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += (REROLE if edit == "R" else 0) + (UNFINISHED if fault == "t" else 0)
            self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
            self._write(ROLE[self.state] if edit == "R" else role, text)
        self.audit.append(edits)

    def _count(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.faults["b"], "duplicate": self.faults["d"],
                "truncated": self.faults["t"], "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def earlier(costs: list[int], after: list[int]) -> list[int]:
    """Cost to the end from each state before a segment, from those behind it."""
    return [min(costs[4 * entry + x] + after[x] for x in STATES) for entry in STATES]


def choose(costs: list[int], edits: list[str], entry: int, after: list[int]) -> str:
    """The least text among the edits that lead to the cheapest end."""
    best = earlier(costs, after)[entry]
    return min(edits[4 * entry + x] for x in STATES if costs[4 * entry + x] + after[x] == best)


def closing(state: int) -> str:
    return "I" * (CLOSING[state] // INSERT)


def _initials(rows: list[Row]) -> list[tuple[str, str]]:
    return [(role[:1], fault) for _, role, _, fault in rows]


def repaired(segments: list[list[Row]]) -> dict:
    """Result of a whole conversation, given in segments."""
    out = Conversation()
    if len(segments) == 1:
        out.add(segments[0], Search(_initials(segments[0])).best(START, None)[1])
        return out.result()
    tables = [Search(_initials(s)).table() for s in segments]
    after = [list(CLOSING)]
    for costs, _ in reversed(tables[1:]):
        after.append(earlier(costs, after[-1]))
    for rows, (costs, edits), rest in zip(segments, tables, reversed(after), strict=True):
        out.add(rows, choose(costs, edits, out.state, rest))
    out.add([], closing(out.state))
    return out.result()


def damage(talk: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the checksum of ``conv_id:turn``.

    Of twenty remainders, 0 drops the row (``present`` is false), 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. A null
    counts as one space, in the checksum, the role and the text. Repeated rows share their fate;
    an empty table gives an empty one.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = talk.select("conv_id", F.col("turn").cast("bigint").alias("turn"), spaced("role").alias("role"),
                       spaced("text").alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("fate") != 0).alias("present"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


ORDER = ("conv_id", "turn", "role", "digest", "row")


def in_order(rows: DataFrame) -> DataFrame:
    """All rows in reading order over ranges, each with its fault.

    A duplicate is marked by a row of its own (``mark``) in front of it, so that texts
    move once, for the order.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "present", F.sha2("text", 256).alias("digest"),
                       F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "chat-rows")
    filled: Column = F.col("text").rlike(FILLED)
    keys = rows.filter(F.col("present") & filled).select(*ORDER)
    # Grouped by the hash of the text; the first of equal rows is the one read first.
    again = (keys.groupBy("conv_id", "role", "digest")
             .agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"),
                                     F.col("digest").alias("_digest"), F.col("first.row").alias("_row")))
    marks = keys.join(again, keys["conv_id"].eqNullSafe(F.col("_conv")) & (keys["role"] == F.col("_role"))
                      & (keys["digest"] == F.col("_digest"))).filter("row <> _row")
    fault = (F.when(~filled, "b").when(~F.col("text").rlike(FINISHED), "t").otherwise(""))
    body = rows.select(*ORDER, "text", fault.alias("fault"), "present", F.lit(False).alias("mark"))
    marks = marks.select(*ORDER, F.lit(None).cast("string").alias("text"), F.lit("d").alias("fault"),
                         F.lit(True).alias("present"), F.lit(True).alias("mark"))
    return (body.unionByName(marks).repartitionByRange(*ORDER)
            .sortWithinPartitions(*ORDER, F.desc("mark")))


SEGMENT = ("seq bigint, turns array<bigint>, roles array<string>, texts array<string>, faults array<string>, "
           "costs array<bigint>, edits array<string>")


def _segments(ordered: DataFrame, settings: Settings) -> DataFrame:
    """Results of the conversations that lie whole in a partition, and the segments of others (``seq``: their order)."""
    kind = ordered.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {RESULT}, {SEGMENT}"
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def runs(some: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Row], bool]]:
        """Rows of a conversation, in segments; the last one of each is marked."""
        conv, rows, seen, marked, size = None, [], False, False, 0
        for b in some:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pydict()
                for c, turn, role, text, fault, present, mark in zip(*part.values(), strict=True):
                    if seen and c != conv:
                        yield conv, rows, True
                        rows, size = [], 0
                    conv, seen = c, True
                    if mark:
                        marked = True
                    elif present:
                        if len(rows) >= settings.segment or size > settings.most_bytes:
                            yield conv, rows, False
                            rows, size = [], 0
                        rows.append((turn, role, text, "d" if marked else fault))
                        size += len(text)
                        marked = False
        if seen:
            yield conv, rows, True

    def open_segment(conv, seq: int, rows: list[Row]) -> dict:
        costs, edits = Search(_initials(rows)).table() if rows else ([], [])
        turns, roles, texts, faults = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        return {"conv_id": conv, "seq": seq, "turns": turns, "roles": roles, "texts": texts, "faults": faults,
                "costs": costs, "edits": edits}

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, spilled, held = TaskContext.get().partitionId() << 32, True, False, []
        out: list[dict] = []

        def spill(conv) -> Iterator[dict]:
            nonlocal seq
            for rows in held:
                yield open_segment(conv, seq, rows)
                seq += 1
            held.clear()

        before = None
        for conv, rows, last in runs(some):
            # What ends a conversation is known to end it only when another one follows.
            if before is not None:
                out.append({"conv_id": before[0], **repaired([s for s in before[1] if s] or [[]])})
                before = None
            held.append(rows)
            if len(held) * settings.segment > settings.most_rows or sum(len(r[2]) for s in held for r in s) > settings.most_bytes:
                spilled = True
                out += spill(conv)
            if last:
                if first or spilled:
                    out += spill(conv)
                else:
                    before = conv, list(held)
                held.clear()
                first = spilled = False
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if before is not None:
            held += before[1]
            out += spill(before[0])
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = _arrow(columns, kind)
    return mapped(ordered.select("conv_id", "turn", "role", "text", "fault", "present", "mark"), batches, schema)


def _arrow(columns: list[str], kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    lists = {"turns": pa.int64(), "costs": pa.int64(), "after": pa.int64(), "roles": pa.string(), "texts": pa.string(),
             "faults": pa.string(), "edits": pa.string()}
    of = {"conv_id": to_arrow_type(kind), "audit": pa.string(), "repaired_sha256": pa.string(),
          **{k: pa.list_(v) for k, v in lists.items()}}
    return pa.schema([(c, of.get(c, pa.int64())) for c in columns])


def _costs_behind(segments: DataFrame) -> DataFrame:
    """``seq, after``: cost to the end from each state behind each segment, from the cost tables alone."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after, seen = None, list(CLOSING), False
        for b in some:
            out = []
            for c, costs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not seen or c != conv:
                    conv, after, seen = c, list(CLOSING), True
                out.append(after)
                after = earlier(costs, after) if costs else after
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.int64()))], ["seq", "after"])

    ordered = (segments.select("conv_id", "seq", "costs").repartition("conv_id")
               .sortWithinPartitions("conv_id", F.desc("seq")))
    return mapped(ordered, batches, "seq bigint, after array<bigint>")


def _put_together(segments: DataFrame) -> DataFrame:
    """Results of conversations given in segments with ``after``."""
    kind = segments.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {RESULT}"
    arrow = _arrow([c.strip().split(" ")[0] for c in schema.split(",")], kind)

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, out = None, None, []

        def finish():
            now.add([], closing(now.state))
            out.append({"conv_id": conv, **now.result()})

        for b in some:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        finish()
                    conv, now = r["conv_id"], Conversation()
                if r["costs"]:
                    rows = zip(r["turns"], r["roles"], r["texts"], r["faults"], strict=True)
                    now.add(rows, choose(r["costs"], r["edits"], now.state, r["after"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            finish()
            yield pa.RecordBatch.from_pylist(out, arrow)

    ordered = segments.drop(*[c.split(" ")[0] for c in RESULT.split(", ")]).repartition("conv_id")
    return mapped(ordered.sortWithinPartitions("conv_id", "seq"), batches, schema)


def repair(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the hash of what they give.

    ``rows``: ``conv_id, turn, role, text`` without null roles and texts, and ``present``; a row
    that isn't present only names its conversation. Rows are read by turn, null turns first, and
    equal turns by role and by hash of the text, so the result doesn't depend on how the table is
    stored. A row's first fault counts: blank, duplicate (role and text read before),
    truncated. A null conversation id is a conversation of its own. Very long texts and conversations are
    cut into segments; repeated rows are duplicates; an empty table gives no rows.
    """
    segments = staged(_segments(in_order(rows), settings), "chat-segments")
    open_ = segments.filter("seq is not null")
    together = _put_together(open_.join(_costs_behind(open_), "seq"))
    return segments.filter("seq is null").select(*together.columns).unionByName(together)
