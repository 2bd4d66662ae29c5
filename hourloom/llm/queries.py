"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, filter_audit, language_id, line_dedup, lm, minhash, ngram_join, pii, quality, spelling, token_counts, token_files
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, lm.held_out("doc_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), least=1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluate(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_ngram_join": op2_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op6_quality_rules": op6_quality_rules,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op5_benchmark_decontamination": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
          SELECT DISTINCT cast(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
          SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT g.doc_id, g.i, g.n, v.item FROM grams g JOIN windows v ON g.n = v.n AND g.k = v.k),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hits GROUP BY doc_id)
        SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        d AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
        firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
        said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        fails AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 2 * length(d.text),
                      'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first, false)} AS f
          FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN said ON d.doc_id = said.doc_id),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
          SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
          WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
        places AS (
          SELECT part, good, toxic, filter_order, f,
                 coalesce(list_position(list_transform(range(1, 6), lambda i: f[substr(filter_order, i, 1)]), true), 6) AS first_failed
          FROM fails, orders),
        counts AS (
          SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
                 count(*) FILTER (first_failed > step) AS kept, count(*) FILTER (first_failed = step) AS removed,
                 count(*) FILTER (first_failed < step AND f[substr(filter_order, step, 1)]) AS redundant,
                 count(*) FILTER (f[substr(filter_order, step, 1)] AND len(list_filter(map_values(f), lambda x: x)) = 1) AS unique_fails,
                 count(*) FILTER (first_failed = step AND good = 1) AS good_lost, count(*) FILTER (first_failed = step AND toxic = 1) AS toxic_lost
          FROM (SELECT *, unnest(range(1, 6))::INTEGER AS step FROM places) GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               cast(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
        FROM counts""",
}
