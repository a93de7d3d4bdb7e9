"""License scan: phrases, and an exact set-similarity join with license templates.

Base labels come from phrases whose words stand consecutively. The join finds every
block of text that contains a template: at least ``threshold`` of the template's
distinct words. Words are ordered by their frequency in the whole table, rarest
first. A block that reaches the threshold must hold a word of the template's
prefix (its rarest words, as many as may be missing and one more), so blocks are
looked up by prefix words only. A length filter (the block has enough different
words) and a positional filter (from the first shared word on, in that order, both the template and
the block have words enough) thin the candidates, and the rest is counted exactly.

Licenses share most of their wording. So a template names the words that tell it apart,
which a block must hold, and of templates of different licenses that meet at one place one goes when
the other holds its telling words among more.

Only column functions and joins are used, and texts never shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.common import ascii_lower, staged, whole

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wording of well-known license notices: label, text, and the words without which it is another's.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction", "permission granted"),
    ("apache", "Released under the Apache License.", "apache"),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
                 "with the License. You may obtain a copy of the License at", "apache 2"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     "commons attribution"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
     "commons attribution noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     "commons attribution sharealike"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License as published by the Free Software Foundation, either version 3 of the License, "
              "or any later version.", "gnu general 3"),
    ("bsd", "Released under the BSD License.", "bsd"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "redistribution binary"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
)
#: Words per cell in which places are compared.
CELL = 64


def from_table(templates: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """Templates from a table of ``label, text, must`` (whole license texts, say), which is small by nature."""
    return tuple(sorted((r["label"], r["text"], r["must"] or "") for r in templates.select("label", "text", "must").collect()))


def _words(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split()


def _scan(docs: DataFrame) -> DataFrame:
    """Words of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.array_remove(F.split(ascii_lower(whole()), NOT_WORD), "").alias("words"))


def _text_array(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``token, df``: rows of the whole table that hold each word of the templates."""
    held = _scan(docs).select(F.explode(F.array_intersect("words", _text_array(vocabulary))).alias("token"))
    return held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def prefixes(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """A row per template and prefix word: ``template, label, token, at, need, tokens, words, must, rank``.

    ``need`` is the number of template words a block must hold, ``at`` the place
    of the prefix word in the template's order, ``rank`` its place among the words of all templates, rarest
    first. As large as the template list.
    """
    spark = docs.sparkSession
    listed = [(i, label, sorted(set(_words(text))), len(_words(text)), _words(must))
              for i, (label, text, must) in enumerate(templates)]
    vocabulary = sorted({t for _, _, tokens, _, _ in listed for t in tokens})
    tokens = spark.createDataFrame(
        [(i, label, t, math.ceil(threshold * len(ts) - 1e-9), n, must) for i, label, ts, n, must in listed for t in ts],
        "template int, label string, token string, need int, words int, must array<string>")
    counted = tokens.join(F.broadcast(frequencies(docs, vocabulary)), "token", "left").fillna(0, ["df"])
    # A few thousand words at most, whatever the input.
    counted = counted.withColumn("rank", F.dense_rank().over(Window.orderBy("df", "token")))
    order = Window.partitionBy("template").orderBy("df", "token")
    placed = counted.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "tokens", F.collect_list("token").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return placed.withColumn("prefix", F.col("at") <= F.size("tokens") - F.col("need")).drop("df")


def _phrase_starts(phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get("words", i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & F.get("words", i + k).eqNullSafe(F.lit(p))
        return out

    n = F.size("words")
    # The phrase's last word is the rare one; most texts lack it.
    return F.when((n >= len(parts)) & F.array_contains("words", max(parts, key=len)) & F.array_contains("words", parts[-1]),
                  F.filter(F.sequence(F.lit(0), n - 1), here)).otherwise(F.expr("cast(array() as array<int>)"))


def _blocks(size: int, rare: Column) -> Column:
    """The blocks, for templates of ``size`` words, that hold one of the rare words."""
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(rare, F.get("words", i)))
    number = lambda i: F.floor(i / size).cast("int")
    near = F.array_distinct(F.flatten(F.transform(
        at, lambda i: F.array(number(i), F.greatest(number(i) - 1, F.lit(0))))))
    cut = F.transform(near, lambda b: F.struct(
        F.lit(size).alias("words"), b.alias("block"),
        F.array_distinct(F.slice("words", b * size + 1, F.lit(2 * size))).alias("held")))
    return F.when((F.size("words") > 0) & F.arrays_overlap("words", rare), cut).otherwise(
        F.expr("cast(array() as array<struct<words:int,block:int,held:array<string>>>)"))


def candidates(met: DataFrame, ranks: Column) -> DataFrame:
    """Blocks and templates that met at a prefix word and may share words enough.

    Length: the block has so many different words. Position: from the word they met at, in the order of ranks,
    the template has so many words left, and the block as many of any template's words.
    """
    later = F.size(F.filter("held", lambda h: ranks[h] >= F.col("rank")))
    return met.filter((F.size("held") >= F.col("need")) & (F.size("tokens") - F.col("at") >= F.col("need"))
                      & (later >= F.col("need")))


def best_fits(shared: DataFrame) -> DataFrame:
    """Matches but for those whose telling words a match of another license at the same place holds among more words.

    Places are compared cell by cell, of which a match has few, so a text of very many notices costs in
    proportion to its length.
    """
    one = shared.select("row_no", "template", "label", "block", "shared", "tokens", "must",
                        (F.col("block") * F.col("words")).alias("start"),
                        (F.col("block") * F.col("words") + 2 * F.col("words")).alias("end")).distinct()
    one = staged(one, "license-matches")
    celled = one.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))).drop("tokens")
    a, b = celled.alias("a"), celled.alias("b")
    beaten = a.join(b, (F.col("a.row_no") == F.col("b.row_no")) & (F.col("a.cell") == F.col("b.cell"))).filter(
        (F.col("a.label") != F.col("b.label")) & (F.size("b.shared") > F.size("a.shared"))
        & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
        & (F.size(F.array_except("a.must", "b.shared")) == 0)).select("a.row_no", "a.template", "a.block").distinct()
    return one.join(beaten, ["row_no", "template", "block"], "left_anti")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    A block is a window of twice the template's length in words, and windows
    step by that length, so every passage as long as a template lies whole in a
    block. A block has a template's label when it holds the threshold share of its words and all of ``must``, and
    no block over the same place holds more words of another license's template, ``must`` among them. ``score``
    is the largest share of such a template, 1 for a phrase, else 0. A null or empty text
    has no words, no labels and score 0. Repeated rows give repeated results, an
    empty table none. Only ``doc_id`` and ``text`` are read.
    """
    every = staged(prefixes(docs, templates, threshold), "license-prefixes")
    prefix = every.filter("prefix").drop("prefix")
    # As many rows as templates, and as different words in them, so small whatever the input.
    listed = prefix.groupBy("words").agg(F.array_sort(F.collect_set("token")).alias("tokens")).collect()
    ranks = F.create_map(*[F.lit(x) for r in every.select("token", "rank").distinct().collect() for x in r])

    d = _scan(docs).withColumn("row_no", F.monotonically_increasing_id())
    for i, phrase in enumerate(PHRASES):
        d = d.withColumn(f"p{i}", _phrase_starts(phrase))
    blocks = [_blocks(r["words"], _text_array(r["tokens"])) for r in listed]
    starts = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(PHRASES))]))
    kept = staged(d.select(
        "doc_id", "row_no", F.size("words").cast("bigint").alias("n_words"), starts.alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label))
                                  for i, label in enumerate(PHRASES.values())])).alias("base"),
        F.flatten(F.array(*blocks)).alias("blocks")), "license-scan")

    held = kept.select("row_no", F.explode("blocks").alias("b")).select(
        "row_no", "b.words", "b.block", "b.held", F.explode("b.held").alias("token"))
    met = held.join(F.broadcast(prefix), ["words", "token"])
    shared = candidates(met, ranks).withColumn("shared", F.array_intersect("tokens", "held")).filter(
        (F.size("shared") >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0))
    found = best_fits(shared).groupBy("row_no").agg(
        F.collect_set("label").alias("more"), F.max(F.size("shared") / F.size("tokens")).alias("best"))
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return kept.join(found, "row_no", "left").select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"), F.array_max("starts").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
