"""The queries of this folder for the driver, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, line_dedup, order_minhash, packing, pii, quality, sharding, substring_dedup, toxicity
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.remainder(F.col("doc_id"), 3) == 1
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out), 0.7, held_out)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), n_shards=40)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.remainder(F.col("doc_id"), 5) == 0
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out), 0.3, held_out)


def tokenizer_path() -> str:
    """A public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=0)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), at_least=10, min_chars=1)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), window=50)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_order_minhash": op8_order_minhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

SQL = {
    "op4_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(0, len(w) - 9) + CASE WHEN len(w) BETWEEN 1 AND 9 THEN 1 ELSE 0 END)) AS i FROM bw)
        ), sizes AS (SELECT DISTINCT n FROM windows), places AS (
            SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM dw CROSS JOIN sizes)
        ), hits AS (
            SELECT DISTINCT doc_id, p.n, i, item_id FROM places p JOIN windows USING (n, k)
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
        ), keyed AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
            FROM lines
        ), counted AS (
            SELECT k, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 1 GROUP BY k
        ), marked AS (
            SELECT keyed.*, coalesce(n >= 10, false) AS gone FROM keyed LEFT JOIN counted USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k
            FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 49))) AS i FROM words)
        ), firsts AS (
            SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN firsts USING (k) WHERE first_id < doc_id
        ), flat AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words
        ), marked AS (
            SELECT flat.*, gone.pos IS NOT NULL AS away FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.pos = gone.pos
        ), summed AS (
            SELECT doc_id, count(*) FILTER (away) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT away) AS kept FROM marked GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN summed USING (doc_id)
    """,
}
