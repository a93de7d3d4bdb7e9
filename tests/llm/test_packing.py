import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import packing


def check_sequences(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_sequences(spark, capacity):
    got = packing.pack(clashing(documents(spark)), capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((-1 if r[0] is None else r[0], k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                  for r in got) == sorted(want)
    used = check_sequences(got, capacity)
    # Full sequences but for the last, on these lengths.
    assert used <= -(-sum(w[3] for w in want) // capacity) + 1


def test_words_alone_give_the_tokens_of_the_text():
    texts = ["a\x0bb c\x0cd\x1ce\x85f　g <|endoftext|> <|ENDOFTEXT|>x İstanbul ΣΑΣ. é don't 'S it's,", "", " \n",
             "x" * 5000 + " ,., ... word... wo.rd, 12.5% a1b2 cats' ''' '", prose(1, 300), "á ́b ʰ ª ½ ²"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY), most_words=3)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_of_words_are_remembered_once():
    words = ["plain", "naïve", "x2", "don't"]
    ends = ["", ".", ",", "...", "?!", "'", ")", "$$$", "2", "42,", "'s", "'st."]
    texts = [f"{a}{e} {b}{e}{a}\n" for a in words for b in words for e in ends]
    texts += ["a<|endoftext|>b", "a|b <|startoftext|x", "=\u0338 a=\u0338, 1\u0301 e\u0301. é. É, Σας. _a_b_ a_1", "½. a½, ²3"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    encoder.encode([f"{a}{e}".encode() for a in ("plain", "words") for e in ends])
    # The two words, nine marks and closings, two digits, 's and 'st.
    assert len(encoder.known) <= 15


def test_plain_words_by_the_merges_alone():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    words = [*packing.LATIN, *prose(5, 300).split(), "straße", "ÿ", packing.LATIN, "s", "'s"]
    for w in words:
        if packing.PLAIN.fullmatch(w.encode()):
            assert encoder._plain_ids(w.encode()) == np.array(
                tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    assert not any(packing.PLAIN.fullmatch(w.encode()) for w in ("É", "×", "÷", "a.", "ā", "'s", ""))


def test_fullest_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {k: items.count(k) for k in items}
        use = packing.fullest(counts, 30)
        seed = max(items)
        rest = list(items)
        rest.remove(seed)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 30 - seed}
        assert all(n <= counts[k] for k, n in use.items())
        assert sum(k * n for k, n in use.items()) == seed + max(sums)


def best_fit_decreasing(histogram, capacity):
    rooms, bins = [0] * (capacity + 1), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = next((r for r in range(length, capacity) if rooms[r]), None)
            if room is None:
                bins, room = bins + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return bins


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {k: rng.randint(1, 20) for k in rng.sample(range(1, 2049), 700)}
    places = packing.plan(histogram)
    for length, n in histogram.items():
        mine = sorted((p[1], p[2]) for p in places if p[0] == length)
        assert [a for a, _ in mine] == np.cumsum([0, *(m for _, m in mine)])[:-1].tolist() and sum(m for _, m in mine) == n
    bins = max(p[3] + p[4] for p in places)
    assert bins <= best_fit_decreasing(histogram, 2048)
    assert packing.plan({}) == []


def test_many_equal_lengths_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 10)
    docs = documents(spark, [(i % 150, "one two three", None, None, None) for i in range(300)])
    got = packing.pack(docs, capacity=64).collect()
    assert check_sequences(got, 64) == 300 * 4 // 64 + 1
    assert packing.pack(documents(spark, [])).count() == 0
