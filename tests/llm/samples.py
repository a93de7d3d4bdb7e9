"""Small tables with every awkward case, for the tests of the text operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéinorst") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return " ".join(words[min(int(rng.expovariate(1 / 60)), vocabulary - 1)] for _ in range(n))


def rows():
    a, b = prose(1, 120), prose(2, 90)
    texts = [a, a.upper().replace("É", "é"), b, b + " more", None, "", "  \n\t ", "one", "one two", "one two three",
             a.replace(" ", "\n"), "x" * 30_000, "= @ + 1.2.3.4 " * 40, prose(3, 6000),
             "mail me at jane.doe@example.com now. " * 2, "日本語 テキスト ▁ \x00 end", "<|endoftext|> <|ENDOFTEXT|>",
             "Released under the MIT License.\n" + prose(4, 80), a, "| cell | cell |" * 50]
    out = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, "no id", None, None, None), (None, a, None, None, 3), (99, None, None, None, None)]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def clashing(df):
    """The table with columns named like those the operators make inside."""
    from pyspark.sql import functions as F

    for c in ("words", "digest", "row_no", "share", "rank", "fp", "grid", "cell", "spans", "score", "kept", "block",
              "held_out", "length", "labels", "n_words", "failed_bits", "_id", "h", "local"):
        df = df.withColumn(c, F.lit("clash"))
    return df
