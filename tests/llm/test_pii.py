import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import pii
from visitlens.llm.common import BATCH_BYTES, mapped


def plain_base(text):
    out = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)], [], [], []]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out[1].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out[2].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out[3].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123459(é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_known_numbers():
    text = "4111 1111 1111 1111, 4111111111111112, 1.2.3.400 001.2.3.4 +1 (555) 123-4567 a@b@c.de x.y@z"
    assert pii.base_spans(text) == plain_base(text) and [len(x) for x in plain_base(text)] == [1, 1, 1, 1]


def test_long_runs_are_fast():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "." * 200_000)[0] == []
    pii.find("=" * 100_000 + " 1=" * 20_000, pii.learn([], pii.Settings()), pii.Settings())


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    k = 3
    unary = rng.normal(size=(5, k))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3], [3, 4]])
    a, b = rng.normal(size=(k, k)), rng.normal(size=(k, k))
    want = np.zeros((5, k))
    for y in itertools.product(range(k), repeat=5):
        e = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(a[y[i], y[j]] for i, j in chain)
                   + sum(b[y[i], y[j]] for i, j in skip))
        want[range(5), y] += e
    got = pii.marginals(unary, [(chain, a), (skip, b)], 60)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


SECRET = "9f86d081884c7d659a2feaa0c55ad015"


def training():
    out = []
    for i in range(80):
        out += [prose(i, 30) + f" password={(SECRET * 2)[i % 20:i % 20 + 18]} " + prose(i, 20),
                prose(i, 20) + f" token = \"{(SECRET[::-1] * 2)[i % 17:i % 17 + 30]}\" end",
                prose(i, 20) + f" jane{i}@mail{i % 7}.example.com and +1 ({200 + i}) 555-{1000 + i} x",
                prose(i, 20) + f" in {1900 + i} there were {i} of {i * 31} parts, version {i % 5}.{i % 3}."]
    return out


def test_repeats_decide_for_each_other():
    field = pii.learn(training(), pii.Settings())
    clear = f"password={SECRET} " + prose(1, 60)
    text = clear + " then zq19xk0 came, key zq19xk0 again"
    _, spans = pii.find(clear + " " + SECRET, field, pii.Settings())
    found = [clear[a:b] if b <= len(clear) else (clear + " " + SECRET)[a:b] for a, b in spans[4]]
    assert found.count(SECRET) == 2
    assert pii.find(text, field, pii.Settings())[0] == plain_base(text)
    clean = prose(7, 200) + " in 1999 there were 12 of 310 parts, version 2.0."
    assert all(not s for s in pii.find(clean, field, pii.Settings())[1])


def test_scan_and_mask(spark):
    extra = [(400 + i, t, None, None, len(t)) for i, t in enumerate(training())]
    docs = clashing(documents(spark, rows() + extra))
    field = pii.train(docs, pii.Settings(most_rows=200))
    got = pii.scan(docs, field).collect()
    assert len(got) == len(rows()) + len(extra)
    text = {r[0]: r[1] or "" for r in rows() + extra}
    for r in got:
        if r["doc_id"] is not None:
            base = plain_base(text[r["doc_id"]])
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(b) for b in base]
            for kind, spans in zip(pii.BASE_KINDS, base, strict=True):
                assert all(f"{kind}:{a}:{b}" in r["spans"].split(",") for a, b in spans)
    hidden = pii.mask(docs, field)
    assert hidden.columns == docs.columns
    after = {r["doc_id"]: r for r in hidden.collect() if r["doc_id"] is not None}
    assert after[4]["text"] is None and after[0]["text"] == text[0]
    assert not any("@mail" in (r["text"] or "") for r in after.values())
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if d >= 400)
    none = documents(spark, [])
    assert pii.scan(none, pii.train(none)).count() == 0 and pii.mask(none, field).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """A task takes long texts some at a time, not by a number of rows."""
    texts = [(i, f"mail jane{i}@example.com " + "x" * 400_000, None, None, None) for i in range(60)]
    docs = documents(spark, texts).repartition(1)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    hidden = pii.mask(docs, pii.learn([], pii.Settings()))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    seen = mapped(docs, sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in seen) == 60 and max(r["bytes"] for r in seen) < 2 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    assert sorted(r["text"][:12] for r in hidden.collect()) == ["mail <email>"] * 60
