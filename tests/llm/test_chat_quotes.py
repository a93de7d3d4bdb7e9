import random

from pyspark.sql import functions as F

from visitlens.llm import chat_quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, hash string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in chat_quotes.conversations(df).collect()}


def test_quotes_are_linked_and_removed(spark):
    got = run(spark, [
        (1, 0, "user", "First line\nSecond line"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "> first   LINE\n> > Unknown words\nBack to the first"),
        (1, 3, "assistant", ">> First line\n> Back to the first\nDeep"),
        (1, 4, "user", "No quote"),
        (2, 0, "user", "> First line\nother conversation"),
    ])
    assert {t: got[1, t]["parent_turn"] for t in range(5)} == {0: None, 1: 0, 2: 0, 3: 2, 4: 3}
    assert {t: got[1, t]["branch"] for t in range(5)} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"], got[1, 2]["max_level"]) == (2, 1, 2)
    assert (got[1, 3]["n_quotes"], got[1, 3]["n_linked"]) == (2, 2)
    assert got[1, 3]["body"] == "Deep" and got[1, 3]["message"] == "<|assistant|>\nDeep"
    assert (got[2, 0]["n_linked"], got[2, 0]["parent_turn"]) == (0, None)


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (3, 5, "user", "> later"), (3, 7, "user", "later"),
            (3, 7, "user", "later"), (3, 9, "x", ">" * 300 + " a")]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)
    out = chat_quotes.conversations(df).collect()
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[3, 5]["n_linked"] == 0 and by[3, 9]["max_level"] == 300 and by[None, 1]["parent_turn"] == -1
    assert chat_quotes.conversations(df.limit(0)).count() == 0


def test_long_conversation_is_one_branch(spark):
    n = 2600
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), (F.col("id") * 3).alias("turn"),
                               F.lit("user").alias("role"), F.concat(F.lit("line "), "id").alias("text"))
    out = chat_quotes.conversations(df)
    assert out.agg(F.count("*"), F.max("branch"), F.sum("parent_turn")).first() == (
        n, 0, sum(3 * i for i in range(n - 1)))


def test_branches_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat_quotes, "SPAN", 7)
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(6):
        answered, branch = set(), {}
        for turn in range(60):
            previous = turn - 1 if turn else None
            parent = rng.randrange(turn) if turn and rng.random() < 0.3 else previous
            opens = parent is None or parent in answered
            branch[turn] = turn if opens else branch[parent]
            answered.add(parent)
            rows.append((str(conv), turn, previous, parent))
            want[str(conv), turn] = branch[turn]
    df = spark.createDataFrame(rows, "conv string, turn bigint, previous bigint, parent bigint")
    got = {(r["conv"], r["turn"]): r["branch"] for r in chat_quotes.branches(df).collect()}
    assert got == want
