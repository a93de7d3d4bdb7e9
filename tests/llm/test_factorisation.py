import numpy as np

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import factorisation as fm


def labelled(spark):
    good = [(2000 + i, prose(i, 120), None, None, None) for i in range(160)]
    bad = [(3000 + i, " ".join(w + "###" for w in prose(i, 120).split()), None, None, None) for i in range(80)]
    labels = [(r[0], int(r[0] < 3000), 0) for r in good + bad] + [(None, 1, 0), (2001, None, 0), (77777, 0, 1)]
    return (documents(spark, rows() + good + bad),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_pair_sum_identity():
    rng = np.random.default_rng(1)
    n = 6 + len(fm.STRUCTURE)
    model = fm.Model(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(len(fm.STRUCTURE)),
                     np.ones(len(fm.STRUCTURE)))
    rows_ = [(np.array([0, 2, 5]), np.array([0.5, 0.2, 0.1]), rng.normal(size=len(fm.STRUCTURE)).tolist()) for _ in range(4)]
    got = fm.logits(model, rows_)
    for (at, x, dense), z in zip(rows_, got, strict=True):
        i = np.concatenate((at, np.arange(6, n)))
        v = np.concatenate((x, np.clip(dense, -6, 6) / np.sqrt(len(dense))))
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(z, model.bias + model.weights[i] @ v + pairs)


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = fm.train(clashing(docs), labels)
    got = {r["doc_id"]: r for r in fm.score(clashing(docs), model).collect() if r["doc_id"] is not None}
    assert len(got) == len({r[0] for r in docs.select("doc_id").collect()} - {None})
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] >= 2000]
    assert len(held) > 30 and np.mean([r["predicted"] == (r["doc_id"] < 3000) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_same_model_twice_and_bounded_sample(spark):
    docs, labels = labelled(spark)
    s = fm.Settings(most_rows=50, epochs=1)
    a, b = fm.train(docs, labels, s), fm.train(docs.repartition(5), labels, s)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors)


def test_without_labels_or_rows(spark):
    docs, labels = labelled(spark)
    model = fm.train(docs, labels.limit(0))
    assert {r["score"] for r in fm.score(docs, model).collect()} <= {r["score"] for r in fm.score(docs, model).collect()}
    assert fm.score(documents(spark, []), model).count() == 0
