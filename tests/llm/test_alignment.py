import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import alignment as al

ODD = ["  two  spaces ", "a\nb\n\n c \t d", " \n", "tail ", "▁mark", "a ▁ b", "<s> </s> <|endoftext|> <0x41>", "don't we'll I'M",
       "é́ ﬁ ２ ½", " x y　z", "\x1c a \x85 b", "日本語 と English", "🎉🎉 ok", "\r\nline\r\n", "a" * 300 + " b" * 300,
       "x  \n  y", ".\nBar", "1234567 89", "​ zero", "﻿bom", "-- -- ---", "tab\t tab", "A  B   C    D"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        letters = al.letters_of_bytes()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if "<|" not in t}
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]

    def groups(self, text):
        if not text:
            return []
        raw = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(self.bytes_a[i] for i in a) != raw or b"".join(self.bytes_b[i] for i in b) != raw:
            return []

        def ends(ids, table):
            at = 0
            for i in ids:
                at += len(table[i])
                yield at, i
        ends_a, ends_b = list(ends(a, self.bytes_a)), list(ends(b, self.bytes_b))
        both = sorted({e for e, _ in ends_a} & {e for e, _ in ends_b})
        out, start = [], 0
        for e in both:
            out.append(([i for p, i in ends_a if start < p <= e], [i for p, i in ends_b if start < p <= e]))
            start = e
        return out


def expected(table):
    plain = Plain()
    found = [(r[0], plain.groups(r[1])) for r in table]
    count = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for doc, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, count


def table():
    texts = [r for r in rows() if not (r[1] and len(r[1]) > 20_000 and " " in r[1])]
    return texts + [(600 + i, t, None, None, None) for i, t in enumerate([*ODD, prose(71, 300), prose(72, 40)])]


@pytest.mark.parametrize("settings", [al.Settings(), al.Settings(most_hot=7, most_parts=50, longest_part=6),
                                      al.Settings(most_hot=1)])
def test_against_all_pairs(spark, settings):
    got = al.alignment(clashing(documents(spark, table())), settings).collect()
    want, _ = expected(table())
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_counts_and_map(spark):
    found = al.aligned(documents(spark, table()), keep_groups=True).cache()
    counts = al.pair_counts(found).cache()
    _, want = expected(table())
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == want
    for r in al.id_map(counts).collect():
        tops = {a: n for (a, b), n in want.items() if b == r["b"]}
        assert r["n"] == max(tops.values()) and r["a"] == min(a for a, n in tops.items() if n == r["n"])
    for r in found.filter("n_groups > 0").limit(5).collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]


def test_regular_pairs_have_equal_bytes():
    of = al.aligner(al.Settings())
    assert of.cut
    pairs = [(a, b) for a, b in enumerate(of.same.tolist()) if b >= 0]
    assert len(pairs) > 10_000 and all(of.bytes_a[a] == of.bytes_b[b] for a, b in pairs)


def test_no_rows(spark):
    assert al.alignment(documents(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in al.alignment(documents(spark, [(1, None, None, None, None)])).collect()] == [(0,) * 6 + ("",)]
