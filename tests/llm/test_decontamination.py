import hashlib
import re

import pytest
from pyspark.sql import types as T

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import decontamination as dec

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LONG = prose(41, 60)
BENCHMARK = [(1, LONG), (2, prose(42, 25) + " and " + " ".join(LONG.split()[20:34])), (3, "One, TWO! three"),
             (10, "one two three"), (4, None), (5, ""), (6, " .,- "), (None, "é日本 word"), (7, "solo"), (7, "solo"),
             (8, " ".join(["again"] * 30))]
MIXED = [
    "before " + LONG.upper().replace("É", "é").replace(" ", " - ") + " after", " ".join(LONG.split()[:9]),
    " ".join(LONG.split()[5:15]) + " x " + " ".join(LONG.split()[25:36]), "One.\ntwo;three four one two", "é日本  WORD",
    "again " * 9, "again " * 10, "again " * 25, "solosolo SOLO", "w " * 3000 + LONG + " w" * 3000, "\x00solo\x7fone two",
]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, n):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        want = words_of(body)
        k = min(n, len(want))
        windows = {tuple(want[i:i + k]) for i in range(len(want) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def table():
    return rows() + [(400 + i, t, None, None, None) for i, t in enumerate(MIXED)] + [(400, MIXED[0], "en", "s", 1)]


@pytest.mark.parametrize("settings", [
    dec.Settings(), dec.Settings(words=3, piece=50), dec.Settings(most_bytes=0), dec.Settings(words=4, most_bytes=0, bitmap_bits=6)])
def test_against_all_windows(spark, settings):
    docs = clashing(documents(spark, table()))
    benchmark = spark.createDataFrame(BENCHMARK, ITEMS).selectExpr("*", "'clash' as doc_id", "1 as window", "2 as row")
    got = dec.contamination(docs, benchmark, settings).collect()
    want = [(r[0], *plain(r[1], BENCHMARK, settings.words)) for r in table()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_hashes_are_told_apart():
    of = dec._window_set([{"window": w, "hash": 5, "item_id": w.decode()} for w in (b"a ", b"b ", b"c ")], [1], 4)
    assert [of.items[of.find(5, w)] for w in (b"c ", b"a ", b"b ")] == [["c "], ["a "], ["b "]]
    assert of.find(5, b"d ") == of.find(6, b"a ") == -1


def test_nothing_on_either_side(spark):
    docs, none = documents(spark), spark.createDataFrame([], ITEMS)
    for settings in (dec.Settings(), dec.Settings(most_bytes=-1)):
        assert dec.contamination(documents(spark, []), spark.createDataFrame(BENCHMARK, ITEMS), settings).count() == 0
        clean = dec.contamination(docs, none, settings)
        assert clean.count() == docs.count() and clean.filter("contaminated or n_items > 0").count() == 0


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_removal(spark, most_bytes):
    settings = dec.Settings(most_bytes=most_bytes)
    part = " ".join(LONG.split()[3:20])
    texts = [f"Keep this, é! {part.upper().replace('É', 'é')}; and (this) too, with words enough to stay {prose(43, 30)}",
             LONG, "clean words", None, f"{part}\n{prose(44, 40)}\n{part}"]
    docs = documents(spark, [(i, t, "l", None, None) for i, t in enumerate(texts)])
    benchmark = spark.createDataFrame(BENCHMARK, ITEMS)
    left = {r["doc_id"]: r["text"] for r in dec.remove_spans(docs, benchmark, settings=settings).collect()}
    assert left == {0: texts[0].replace(part.upper().replace("É", "é"), ""), 2: "clean words", 3: None,
                    4: f"\n{prose(44, 40)}\n"}
    whole = dec.remove_documents(docs, benchmark, settings)
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3] and whole.columns == docs.columns
