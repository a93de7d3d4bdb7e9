import hashlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import exact_dedup, simhash
from visitlens.llm.components import components
from visitlens.session import new_folder

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def index(spark):
    return exact_dedup.DigestIndex(spark, new_folder(spark, "index"), buckets=4)


def test_exact_decisions(spark):
    got = exact_dedup.ingest(clashing(documents(spark)), index(spark)).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[hashlib.sha256((r[1] or "").translate(UPPER).encode()).hexdigest()].append(r[0])
    assert len(got) == len(rows())
    kept = defaultdict(int)
    for r in got:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (max(known) if known else None)
        assert r["group_size"] == len(ids)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_index_lasts_and_repeats(spark):
    ix = index(spark)
    first = documents(spark, [(1, "A b", None, None, 1), (2, "c", None, None, 1)])
    second = documents(spark, [(9, "a B", None, None, 1), (8, "d", None, None, 1), (7, "D", None, None, 1)])
    exact_dedup.ingest(first, ix, "one").collect()
    for _ in range(2):  # a batch may be run again
        got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.ingest(second, ix, "two").collect()}
        assert got == {9: (1, False), 8: (8, True), 7: (8, False)}
    spark.sql(f"DROP TABLE `{ix.name}`")
    assert exact_dedup.DigestIndex(spark, ix.path, buckets=4).open().rows().count() == 3


def test_drop_copies_keeps_columns_and_one_row(spark):
    docs = documents(spark)
    left = exact_dedup.drop_copies(docs, index(spark))
    assert left.columns == docs.columns
    texts = [(r["text"] or "").translate(UPPER) for r in left.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(UPPER) for r in rows()})


def test_drops_leave_columns_of_any_name(spark):
    docs = documents(spark)
    for c in ("_digest", "_print", "row_no", "gone", "a.b"):
        docs = docs.withColumn(c, F.lit(c))
    for drop in (lambda d: exact_dedup.drop_copies(d, index(spark)), simhash.drop_near):
        left = drop(docs)
        assert left.columns == docs.columns
        assert {tuple(r)[-5:] for r in left.collect()} == {("_digest", "_print", "row_no", "gone", "a.b")}


def test_groups_without_ids_keep_one_row(spark):
    """A group whose ids are all null must not bring other rows with null ids along."""
    docs = documents(spark, [(None, prose(1, 90), None, None, 1), (None, prose(1, 90), None, None, 2),
                             (3, prose(5, 90), None, None, 3), (None, prose(5, 90), None, None, 4)])
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near(docs).collect()) == [0, 3]


def test_two_paths_never_share_an_index(spark):
    long = "x" * 90
    a, b = (exact_dedup.DigestIndex(spark, f"/{top}/{long}") for top in "ab")
    assert a.name != b.name


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.ingest(none, index(spark)).count() == 0
    assert exact_dedup.drop_copies(none, index(spark)).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.drop_near(none).count() == 0


def plain_fingerprint(text):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    base = prose(5, 300).split()
    out = []
    for i in range(60):
        words = list(base)
        words[i * 4 % 300] = f"changed{i}"
        if i % 2:
            words[i * 7 % 300] = "twice"
        out.append((100 + i, " ".join(words), None, None, None))
    return out


def test_simhash_groups_against_all_pairs(spark):
    table = [r for r in rows() if r[0] is not None] + near_texts()
    got = simhash.near_groups(clashing(documents(spark, table))).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in table]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((i, f"{a:016x}", find(i)) for i, a in prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_near_dedup_broadcasts_no_table_of_the_input(spark, monkeypatch):
    """Spark sizes these tables too low: an explode's rows are not counted, and files are packed."""
    plans, write = {}, simhash.staged

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(df, label):
        plans[label] = plan(df)
        return write(df, label)

    monkeypatch.setattr(simhash, "staged", noted)
    prints = write(spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(50)], "fp bigint"), "fp")
    plans["links"] = plan(simhash.links(prints))
    docs = write(documents(spark, near_texts()), "docs")
    simhash.drop_near(docs)
    near = simhash.near_groups(docs)
    plans["result"] = plan(near)
    assert near.count() == len(near_texts())
    assert "near-groups" in plans and "Join" in plans["links"] and "Join" in plans["result"]
    assert [label for label, p in plans.items() if "Broadcast" in p] == []


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5])
def test_grid_join_loses_no_link(spark, bits):
    import random

    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for k in range(1, 7):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), bits)
           .collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want


def test_fingerprint_chunks_agree(monkeypatch):
    text = prose(6, 500).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_drop_near_keeps_one_of_each_group(spark):
    docs = documents(spark, near_texts() + [(500, prose(9, 200), None, None, None)] * 2)
    left = simhash.drop_near(docs)
    groups = simhash.near_groups(docs).select("component_id").distinct().count()
    assert left.count() == groups and left.columns == docs.columns


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}}
