"""Named queries of the text operators, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from visitlens.llm import (
    alignment, chat_quotes, chat_repair, class_lm, decontamination, exact_dedup, factorisation, license_scan, packing,
    pieces, pii, quality_rules, simhash)
from visitlens.llm.common import table
from visitlens.session import configure, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(configure(spark), folder)
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_exact_dedup", f"""
    with d as (select doc_id, sha256({LOWER}) as text_sha256 from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from d""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table as the first batch of a new index."""
    index = exact_dedup.DigestIndex(spark, new_folder(spark, "digest-index"))
    return exact_dedup.ingest(table(spark, folder, "documents"), index)


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"), words=3, max_bits=3)


@query("op1_sentencepiece_nbest")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.digests(docs, pieces.train(docs), n=4)


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query("op5_quality_rules", r"""
    with d as (
      select doc_id, coalesce(text, '') as text,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
      from documents),
    starts as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d),
    windows as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from starts),
    repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
    places as (select doc_id, unnest([i, i + 1, i + 2]) as place from repeated),
    covered as (select doc_id, count(distinct place) as n from places group by doc_id),
    m as (
      select doc_id, len(words)::bigint as n_words, length(list_aggregate(words, 'string_agg', ''))::bigint as chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::bigint as n_upper,
             ((length(text) - length(replace(text, '!!', ''))) / 2)::bigint as n_exclaimed,
             coalesce(n, 0)::bigint as n_repeat_words
      from d left join covered using (doc_id)),
    f as (
      select *, coalesce(chars, 0) as word_chars,
             (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
             + 4 * (10 * n_symbols > 3 * n_words)::bigint + 8 * (n_lines >= 4 and 2 * n_dup_lines > n_lines)::bigint
             + 16 * (coalesce(chars, 0) < 2 * n_words or coalesce(chars, 0) > 20 * n_words)::bigint
             + 32 * (n_upper > 50 and 2 * n_upper > coalesce(chars, 0))::bigint
             + 64 * (10 * n_exclaimed > 3 * n_words)::bigint as failed_bits
      from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits % 4 <> 0 as base_failed,
           failed_bits = 0 as kept, failed_bits, '1' as policy_version
    from f""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_bits", "policy_version")


@query("op6_chat_quotes")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return chat_quotes.conversations(table(spark, folder, "conversations"))


@query("op7_class_lm")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score_texts(table(spark, folder, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return factorisation.score(docs, factorisation.train(docs, table(spark, folder, "labels")))


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.scan(docs, pii.train(docs))


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"))


@query("op13_chat_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damage(table(spark, folder, "conversations")))


@query("op12_decontamination", f"""
    with d as (select row_number() over () as row, doc_id, list_filter(
                 string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
               from documents),
    b as (select distinct coalesce(item_id::varchar, '') as item_id, list_filter(
            string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
          from benchmark),
    items as (select *, least(10, len(words)) as k from b where len(words) > 0),
    places as (select item_id, words, k, unnest(range(1, len(words) - k + 2)) as i from items),
    windows as (select distinct item_id, k, array_to_string(words[i:i + k - 1], ' ') as w from places),
    starts as (select row, words, k, unnest(range(1, len(words) - k + 2)) as i
               from d, (select distinct k from items) where len(words) >= k),
    hits as (select row, i, s.k as k, item_id from starts s
             join windows w on w.k = s.k and w.w = array_to_string(s.words[i:i + s.k - 1], ' ')),
    hit_words as (select row, count(distinct place) as n
                  from (select row, unnest(range(i, i + k)) as place from hits) group by row),
    hit_items as (select row, count(distinct item_id) as n,
                         string_agg(distinct item_id, ',' order by item_id) as ids from hits group by row)
    select doc_id, len(words)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit,
           coalesce(t.n, 0)::bigint as n_items, sha256(coalesce(t.ids, '')) as items_sha256, h.n is not null as contaminated
    from d left join hit_words h using (row) left join hit_items t using (row)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES["pipeline"] = lambda spark, folder: corpus_pipeline.run(configure(spark), folder)
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
