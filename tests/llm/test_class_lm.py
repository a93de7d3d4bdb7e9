import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import class_lm


def table():
    return [r for r in rows() if r[0] is not None] + [
        (1000 + i, prose(i % 3, 150, 200), None, None, None) for i in range(120)]


def lower(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def scored(spark):
    s = class_lm.Settings(classes=8, rounds=3, block_tokens=3000)
    return class_lm.score_texts(clashing(documents(spark, table())), s).collect()


def test_base_columns(scored):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter()
    for d, text, *_ in table():
        if not held(d):
            count.update([*lower(text), b""])
    n, v = sum(count.values()), len(count)
    want = []
    for d, text, *_ in table():
        t = [*lower(text), b""]
        want.append((d, held(d), len(t), sum(x in count for x in t), n,
                     round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 5)))
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
                  for r in scored) == sorted(want)


def test_model_beats_words_on_texts_held_out(scored):
    prose_rows = [r for r in scored if r["held_out"] and r["doc_id"] >= 1000]
    assert len(prose_rows) > 5
    assert sum(r["score"] for r in prose_rows) > sum(r["base_score"] for r in prose_rows)


def test_exchange_raises_the_class_information(spark):
    rows_ = [(i, " ".join(f"{a}{j} {b}{(i + j) % 9}" for j, (a, b) in enumerate([("det", "noun")] * 9)), None, None, None)
             for i in range(200)]
    s = class_lm.Settings(classes=5, rounds=3)
    corpus = class_lm.Corpus(documents(spark, rows_), s)

    words, steps = corpus.trained()
    # What a plain count of neighbours over the training texts says.
    of = {bytes(r["word"]): r["class"] for r in corpus.named(words).collect()} | {b"": 0}
    pairs = Counter()
    for d, text, *_ in rows_:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            classes = [0, *(of[t] for t in lower(text)), 0]
            pairs.update(zip(classes, classes[1:]))
    n = sum(pairs.values())
    first, second = Counter(), Counter()
    for (a, b), c in pairs.items():
        first[a] += c
        second[b] += c
    plain = sum(c / n * math.log(c * n / first[a] / second[b]) for (a, b), c in pairs.items())
    assert abs(corpus.information(words) - plain) < 1e-9 and abs(steps[-1] - plain) < 1e-9
    assert len(steps) > 1 and steps == sorted(steps) and words.count() == corpus.words.count()


def test_a_round_that_lowers_the_information_is_undone(spark, monkeypatch):
    s = class_lm.Settings(classes=6, rounds=2, block_tokens=400)
    corpus = class_lm.Corpus(documents(spark, table()), s)
    worse = lambda left, right, own, matrix: np.ones(len(own), np.int64)
    monkeypatch.setattr(class_lm, "best_classes", worse)
    words, steps = corpus.trained()
    assert words is corpus.words and len(steps) == 1
    assert corpus.information(words) == steps[0] > 0


def test_number_of_classes_is_checked():
    with pytest.raises(ValueError):
        class_lm.Settings(classes=129)


def test_scores_against_a_plain_count(spark):
    """The formula, from the classes the training ends with."""
    s = class_lm.Settings(classes=7, rounds=1, block_tokens=900)
    corpus = class_lm.Corpus(documents(spark, table()), s)
    words, _ = corpus.trained()
    of = {bytes(r["word"]): r["class"] for r in corpus.named(words).collect()}
    cls = lambda w: 0 if not w else of.get(w, int(class_lm.first_class([w], 7)[0]))
    count, pairs, held = Counter(), Counter(), lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    for d, text, *_ in table():
        if not held(d):
            t = [b"", *lower(text), b""]
            count.update(t[1:])
            pairs.update((cls(a), cls(b)) for a, b in zip(t, t[1:]))
    rows_of, tokens, types = Counter(), Counter(), Counter()
    for (a, _), n in pairs.items():
        rows_of[a] += n
    for w, n in count.items():
        tokens[cls(w)] += n
        types[cls(w)] += 1

    def plain(text):
        t = [b"", *lower(text), b""]
        return sum(math.log10((pairs[cls(a), cls(b)] + s.add_transition) / (rows_of[cls(a)] + 7 * s.add_transition))
                   + math.log10((count[b] + s.add_word) / (tokens[cls(b)] + s.add_word * (types[cls(b)] + 1)))
                   for a, b in zip(t, t[1:]))

    got = sorted((r["doc_id"], round(r["score"], 5)) for r in corpus.score(words).collect())
    assert got == sorted((d, round(plain(text), 5)) for d, text, *_ in table())


def test_exchange_does_not_depend_on_batches(spark):
    """A word's rows may lie in several Arrow batches, and its blocks in several rows."""
    s = class_lm.Settings(classes=6, rounds=1, block_tokens=400)

    def moved():
        corpus = class_lm.Corpus(documents(spark, table()), s)
        return {(bytes(r["word"]), r["n"], r["class"], r["changed"])
                for r in corpus.named(corpus.exchange(corpus.words)).collect()}

    plain, key = moved(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert moved() == plain and any(r[3] for r in plain)
    finally:
        spark.conf.set(key, before)


def test_best_class_leaves_out_the_word_itself():
    matrix = np.array([[0, 5, 5], [5, 40, 0], [5, 0, 40]], float)
    left = np.array([[0.0, 9.0, 0.0], [0.0, 0.0, 9.0]])
    assert class_lm.best_classes(left, left, np.array([2, 2]), matrix).tolist() == [1, 2]


def test_nothing(spark):
    assert class_lm.score_texts(documents(spark, [])).count() == 0


def test_lists_move_as_few_rows(spark):
    """A task's entries for a block move together; each block's list is whole and in order."""
    s = class_lm.Settings(classes=6, rounds=1, block_tokens=400)
    corpus = class_lm.Corpus(documents(spark, table()), s)
    want = {}
    for r in corpus.places.collect():
        want.setdefault(r["block"], {})[r["local"]] = (r["n"], r["id"] if r["strong"] else -1)
    got, parts = {}, 0
    for block, row in ((r["block"], r["list"]) for r in corpus.lists.collect()):
        n, name = class_lm._list(class_lm.pa.array([[bytes(x) for x in row]]))
        got[block], parts = dict(enumerate(zip(n.tolist(), name.tolist()))), parts + len(row)
    assert len(want) > 3 and got == want
    assert parts <= len(want) * corpus.places.rdd.getNumPartitions() < corpus.places.count()


def test_words_are_those_of_a_plain_split():
    texts = [b"", b" ", b"One\ttwo\x0bTHREE\x0cfour\r\nfive", "ÄÖ éTÉ x　Y".encode(), b"a\x00B\x1cc d",
             b"  lead", b"trail \n", b"x", b"", b"joined"]
    data, starts, per = class_lm._words(class_lm.pa.array(texts))
    ends = np.append(starts[1:], len(data))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in t.lower().split()]
    assert per.tolist() == [len(t.split()) for t in texts]


def test_words_move_as_parts(spark):
    """What stands around the words moves as a row per block and share, with every count, and classes come back to
    the words they belong to however the words are shared out."""
    long = [(5000, "q " * 70_000 + "r", None, None, None)]
    some = documents(spark, table() + long)
    s, other = (class_lm.Settings(classes=6, rounds=2, block_tokens=n) for n in (9000, 1000))
    corpus = class_lm.Corpus(some, s)
    blocks, rows = corpus.texts.count(), corpus.contexts(corpus.words).collect()
    seen = sum(r["n"] for r in corpus.named(corpus.words).collect())
    assert s.shares > 1 == other.shares and blocks > 2
    assert len(rows) <= blocks * s.shares < corpus.places.filter("strong").count()
    assert sum(int(class_lm._values(bytes(r["times"]), "<u2").sum(dtype=np.int64)) for r in rows) == 2 * seen

    def scores(settings):
        return sorted((r["doc_id"], round(r["base_score"], 6), round(r["score"], 6))
                      for r in class_lm.score_texts(some, settings).collect())

    assert scores(s) == scores(other)
