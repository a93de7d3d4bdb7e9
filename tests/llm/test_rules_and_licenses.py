import re

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import clashing, documents, prose, rows
from visitlens.llm import license_scan, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_measures(spark):
    got = quality_rules.ledger(clashing(documents(spark))).collect()
    want = sorted((r[0] if r[0] is not None else -1, *plain_measures(r[1])) for r in rows())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"],
                   r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_verdict_and_columns(spark):
    docs = documents(spark)
    judged = quality_rules.judge(docs)
    assert judged.filter("base_failed and kept").count() == 0
    assert judged.filter("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count() > 0
    assert quality_rules.keep_good(documents(spark, [])).count() == 0


def test_ablations_against_rows(spark):
    entries = quality_rules.ledger(documents(spark, rows() + [(200 + i, prose(i, 40 + i), None, None, None)
                                                              for i in range(30)])).cache()
    policy = quality_rules.Policy("t", ("few_words", "symbols"), ("repeated_windows", "upper_case", "word_length"), 1)
    got = {r["rule"]: tuple(r)[1:] for r in quality_rules.ablations(entries, policy).collect()}
    bits = [r["failed_bits"] for r in entries.collect()]
    of = {r.name: 1 << r.bit for r in quality_rules.RULES}

    def ok(b, hard, soft):
        return not any(b & of[n] for n in hard) and sum(bool(b & of[n]) for n in soft) <= policy.most_soft

    for name in policy.hard + policy.soft:
        hard, soft = [n for n in policy.hard if n != name], [n for n in policy.soft if n != name]
        want = (sum(bool(b & of[name]) for b in bits),
                sum(not ok(b, policy.hard, policy.soft) and ok(b, hard, soft) for b in bits),
                sum(ok(b, hard, soft) for b in bits))
        assert got[name] == want


LICENSED = [
    "Released under the MIT License.\n" + prose(11, 60),
    prose(12, 70) + "\nLicensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.\n" + prose(13, 10),
    prose(14, 200) + " Permission is hereby granted free of charge, to any person obtaining copies of this software and "
    "associated documentation files to deal in the Software without restriction " + prose(15, 200),
    "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the "
    "following conditions are met", "under the mit license under the mit license", "MIT license under the", "",
    " ".join(prose(16, 40).split()[i] + " license" for i in range(40)),
]


def plain_scan(text, threshold=license_scan.THRESHOLD):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best, found = set(base), 1.0 if base else 0.0, []
    for label, template, must in license_scan.TEMPLATES:
        tokens = license_scan._words(template)
        for start in range(0, max(len(words), 1), len(tokens)):
            held = set(words[start:start + 2 * len(tokens)])
            shared = set(tokens) & held
            if len(shared) / len(set(tokens)) >= threshold and held >= set(must.split()):
                found.append((label, start, start + 2 * len(tokens), shared, len(shared) / len(set(tokens)), set(must.split())))
    for label, start, end, shared, share, must in found:
        if not any(o[0] != label and len(o[3]) > len(shared) and must <= o[3] and start < o[2] and o[1] < end
                   for o in found):
            labels.add(label)
            best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(best, 9))


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_license_scan_against_all_blocks(spark, threshold):
    table = rows() + [(300 + i, t, None, None, None) for i, t in enumerate(LICENSED)]
    got = license_scan.scan(clashing(documents(spark, table)), threshold=threshold).collect()
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"],
                    r["labels"], round(r["score"], 9)) for r in got), key=key) == sorted(
        ((r[0], *plain_scan(r[1], threshold)) for r in table), key=key)


NOTICES = {
    "Licensed under CC BY 4.0.": "cc-by",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "Released under the BSD License.": "bsd", "Released under the Apache License.": "apache",
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Released under the Something License.": "",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.": "apache-2,mit",
}


def test_each_notice_has_its_own_label(spark):
    table = [(i, f"{prose(50 + i, 30)}\n{t}\n{prose(70 + i, 30)}", None, None, None) for i, t in enumerate(NOTICES)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(documents(spark, table)).collect()}
    assert list(map(got.get, range(len(NOTICES)))) == list(NOTICES.values())


def test_templates_from_a_table(spark):
    rows_ = [("own", "The quick license says do as you like with this text", "quick"), ("other", "Do not copy this", None)]
    templates = license_scan.from_table(spark.createDataFrame(rows_, "label string, text string, must string"))
    docs = documents(spark, [(1, "x the quick license says: do as you like with this", None, None, None),
                             (2, "the license says do as you like with this text", None, None, None)])
    assert [r["labels"] for r in license_scan.scan(docs, templates).orderBy("doc_id").collect()] == ["own", ""]


def test_positional_filter_removes_candidates(spark):
    met = spark.createDataFrame([
        (["a", "b", "c", "d", "e"], 4, 1, 2, ["b", "x", "c", "d"]),   # no later word in the block: gone
        (["a", "b", "c", "d", "e"], 4, 1, 2, ["b", "c", "d", "e"]),   # enough left on both sides
        (["a", "b", "c", "d", "e"], 4, 2, 3, ["c", "d", "e", "x"]),   # too few left of the template
        (["a", "b", "c", "d", "e"], 4, 0, 1, ["a", "b", "c"]),        # block too short
    ], "tokens array<string>, need int, at int, rank int, held array<string>")
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate("abcde") for x in (t, i + 1)])
    assert [r["held"] for r in license_scan.candidates(met, ranks).collect()] == [["b", "c", "d", "e"]]


def test_license_scan_of_nothing(spark):
    assert license_scan.scan(documents(spark, [])).count() == 0
