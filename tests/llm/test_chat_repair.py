import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from visitlens.llm import chat_repair as cr

TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def cheapest(rows):
    """Dijkstra over (cost, edits as text): the first accepted is the cheapest, least one."""
    agenda, done = [(0, "", 0, "")], set()
    while True:
        cost, edits, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, edits
        after = "a" if state == "u" else "u"
        heapq.heappush(agenda, (cost + 5, edits + "I", i, after))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(agenda, (cost + 2, edits + "D", i + 1, state))
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                heapq.heappush(agenda, (cost + 1 + extra, edits + "R", i + 1, after))
                if initial == after or (initial == "s" and state == ""):
                    heapq.heappush(agenda, (cost + extra, edits + "K", i + 1, initial))


def plain(rows):
    """Expected result of one conversation from its damaged rows, in order."""
    marked, seen = [], set()
    for _, role, text in rows:
        if not re.search(cr.FILLED, text):
            fault = "b"
        elif (role, text) in seen:
            fault = "d"
        else:
            fault = "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t"
            seen.add((role, text))
        marked.append((role[:1], fault))
    cost, edits = cheapest(marked)
    out, state, todo = [], "", iter(rows)
    for e in edits:
        _, role, text = (None, None, "") if e == "I" else next(todo)
        if e == "D":
            continue
        after = {"u": "assistant"}.get(state, "user")
        role = role if e == "K" else after
        out.append(f"{role}:{text}")
        state = role[0]
    turns = {t for t, _, _ in rows if t is not None}
    kinds = [f for _, f in marked]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"),
            kinds.count("t"), sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(marked)),
            cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(table):
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2]))
    return {c: plain(sorted(rows, key=order)) for c, rows in by.items()}


def talk(seed, convs, most, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(["Fine.", "Yes!", "no end", "", " \n", None, f"Text {rng.random()}.", f"open {rng.random()}"])
            out.append((c, t + rng.randint(0, 1) if rng.random() < 0.9 else rng.choice([None, t + 7]), role, text))
    return out


AWKWARD = [(None, None, None, None), (None, 3, "user", "Hi."), (-1, 5, "assistant", "x" * 50_000), (-1, 5, "assistant", "x" * 50_000),
           (-2, None, "user", "a."), (-2, None, "assistant", "b."), (10**15, 10**14, "system", "Only."), (7, 1, "\U0001f600", "é.")]


def test_search_against_dijkstra():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("uuaasx"), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randint(0, 14))]
        assert cr.Search(rows).best(cr.START, None) == cheapest(rows)


def test_segments_against_dijkstra():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(i, rng.choice(["user", "assistant", "assistant", "system", "tool"]), f"text {i}", rng.choice(["", "", "t", "b"]))
                for i in range(rng.randint(2, 16))]
        size = rng.randint(1, 5)
        got = cr.repaired([rows[i:i + size] for i in range(0, len(rows), size)])
        assert (got["cost"], got["audit"]) == cheapest([(r[1][:1], r[3]) for r in rows])


def test_edits_match_the_grammar():
    for n in range(5):
        for initials in itertools.product("uas", repeat=n):
            _, edits = cr.Search([(i, "") for i in initials]).best(cr.START, None)
            assert len(edits.replace("I", "")) == n


@pytest.mark.parametrize("settings", [cr.Settings(), cr.Settings(segment=2, most_rows=4), cr.Settings(segment=3, most_rows=1000),
                                      cr.Settings(segment=1, most_rows=0)])
def test_against_brute_force(spark, settings):
    table = AWKWARD + talk(1, 40, 9) + [(500, *r[1:]) for r in talk(2, 60, 6)]
    df = spark.createDataFrame(table, TALK).repartition(5).selectExpr("*", "'clash' as row", "1 as fault", "2 as mark", "3 as seq")
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair(cr.damage(df), settings).collect()}
    assert got == expected(table)


def test_no_rows(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], TALK))).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = cr.repair(cr.damage(spark.createDataFrame([(1, gone, "user", "x.")], TALK))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_other_kinds_of_id(spark):
    rows = [("a", 1, "user", "x."), ("", 1, "user", "x."), (None, 1, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = cr.repair(cr.damage(df))
    assert got.schema["conv_id"].dataType.simpleString() == "string"
    assert {r["conv_id"] for r in got.collect()} == {"a", "", None}
