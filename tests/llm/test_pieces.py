import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import pieces


PATH = public_tokenizers.path(pieces.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counts(spark):
    return pieces.train(documents(spark))


@pytest.fixture(scope="module")
def lattice(counts):
    return pieces.Lattice(PATH, counts)


def test_counts_are_those_of_whole_texts(spark, model, counts):
    want = Counter(i for r in rows() if r[1] for i in model.encode(r[1].replace("▁", " ")))
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == want
    assert not pieces.train(documents(spark, [])).any()
    assert (pieces.train(documents(spark), most_words=10) == counts).all()


def test_scores_are_log_probabilities(lattice, counts):
    scores = np.array([s for s, _ in lattice.scores.values()])
    assert abs(np.exp(scores).sum() - 1) < 1e-5
    ids = [i for _, i in lattice.scores.values()]
    assert (np.diff(scores[np.argsort(counts[ids], kind="stable")]) >= 0).all()


def test_share_of_words_segmented_as_by_the_library(spark, sample_dir, model):
    """Merging is greedy and the lattice is not, so not all words agree; most do."""
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    lattice = pieces.Lattice(PATH, pieces.train(docs))
    words = Counter(w for r in docs.collect() for w in pieces.words_of(r["text"]) if w.strip("▁"))
    known = lattice.learn([list(words)])
    same = sum(n for w, n in words.items() if known[w][0] == np.array(model.encode(w[1:]), "<u4").tobytes())
    assert same / sum(words.values()) > 0.8


def every_path(lattice, word):
    edges = lattice.edges(word)

    def back(node):
        if not node:
            return [(0.0, [])]
        return [(s + x, [*p, word[a:node]]) for a, x in edges[node] for s, p in back(a)]

    return sorted((s for s, _ in back(len(word))), reverse=True)


WORDS = ["▁", "▁▁▁", "▁▁b", "▁a", "▁the", "▁thing", "▁é日", "▁a.\nb", "▁re-do", "▁\x00", "▁Zürich", "▁çon", "▁x1,2"]


def test_search_and_sweep_against_all_paths(lattice):
    solved = lattice.solve(WORDS)
    for word, (ids, score, loss) in zip(WORDS, solved, strict=True):
        every = every_path(lattice, word)
        assert [s for s, _ in lattice.n_best(word, 7)] == every[:7]
        assert score == every[0]
        assert loss == (every[0] - every[1] if len(every) > 1 else float("inf"))
        assert lattice.decode(ids) == word[1:].replace("▁", " ")


def test_words_of_one_length_together(lattice):
    words = sorted({w for i in range(6) for w in pieces.words_of(prose(i, 400) + " 日本 \x00é aé日 ﬁx")}, key=len)
    for n in {len(w) for w in words}:
        some = [w for w in words if len(w) == n]
        assert lattice._solve_equal(some) == lattice.solve(some)


def test_n_best_of_a_text_against_all_sums(lattice):
    text = "the  thing is so"
    every = [every_path(lattice, w) for w in ("▁the", "▁▁thing", "▁is", "▁so")]
    sums = sorted((sum(c) for c in itertools.product(*every)), reverse=True)
    (_, scores, changes), = lattice.encode([text], 9)
    assert scores == sums[:9] and changes[0] == [] and len(changes) == 9


ENDED = ["cat.\nDog, cat", " (naïve)\x01\x01 x", "日本語。 12.5%\n\n", "", "  ", "don't -- stop...", "▁a▁.b ", "\x00é\x01"]


def test_parts_are_the_text_and_no_piece_goes_on_behind_one(lattice):
    parts, which, bounds = pieces.parts_of(pa.array(ENDED, pa.string()).slice(1), lattice.borders)
    for text, a, b in zip(ENDED[1:], bounds, bounds[1:], strict=False):
        row = [parts[i] for i in which[a:b]]
        assert "".join(row) == ("▁" + text.replace(" ", "▁") if text else "")
        assert not any(x[-1] + y[0] in piece for x, y in itertools.pairwise(row) for piece in lattice.scores)
    assert len(set(parts)) == len(parts)


def test_best_of_parts_is_the_best_of_the_whole(lattice):
    for text, (ids, scores, _) in zip(ENDED, lattice.encode(ENDED, 4), strict=True):
        if text:
            want = lattice.n_best("▁" + text.replace(" ", "▁"), 4)
            assert scores == [s for s, _ in want]
            assert ids == lattice.solve(["▁" + text.replace(" ", "▁")])[0][0]
    back = lattice.decode_all([ids for ids, _, _ in lattice.encode(ENDED)])
    assert [x.decode() for x in back] == [t.replace("▁", " ") for t in ENDED]


def test_counts_of_parts(spark, model):
    texts = [t for t in ENDED if t] * 3
    want = Counter(i for t in texts for i in model.encode(t.replace("▁", " ")))
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    assert {i: n for i, n in enumerate(pieces.train(docs, most_words=4).tolist()) if n} == want


def test_a_word_and_its_ends_are_solved_once(counts):
    lattice = pieces.Lattice(PATH, counts)
    lattice.encode([f"cat{e} dog{e}" for e in ("", ".", ",", "\n", ".\n", ")", "?", "\n\n")], 4)
    assert {w for w in lattice.known if "c" in w or "d" in w} == {"▁cat", "▁dog"}


def test_ties_do_not_widen_the_search(lattice):
    found = lattice.n_best("▁" + "ab" * 400, 3)
    assert len(found) == 3 and found[0][0] >= found[1][0] >= found[2][0]


def test_memory_bound_changes_nothing(counts):
    texts = [prose(i, 200) for i in range(6)]
    few, many = pieces.Lattice(PATH, counts, most_words=5), pieces.Lattice(PATH, counts)
    assert [few.encode([t], 3) for t in texts] == [many.encode([t], 3) for t in texts]


def test_round_trip_and_library(spark, lattice, counts, model):
    got = {r["doc_id"]: r for r in pieces.digests(clashing(documents(spark)), counts).collect()}
    assert len(got) == len({r[0] for r in rows()}) and all(r["round_trip"] for r in got.values())
    encoded = pieces.encode(documents(spark), counts, n=3)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect()}
    assert back == {(r[0], (r[1] or "").replace("▁", " ")) for r in rows()}
    text = prose(1, 50)
    (ids, _, _), = lattice.encode([text])
    assert model.decode([int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)]) == text
    assert pieces.digests(documents(spark, []), counts).count() == 0
