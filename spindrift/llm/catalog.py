"""Registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import binpack, bpe, decontaminate, fertility, lines, quality, relative, simhash, styletree, surrogates

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(table(spark, sf_dir, "pages"))


def op4_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.digests(relative.dedup(table(spark, sf_dir, "documents")))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("copy")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), key="spindrift")


def op8_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.digests(binpack.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op9_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_edit_join, op2_byte_bpe, op3_site_style_tree, op4_naive_bayes_svm, op5_relative_lempel_ziv, op6_qgram_decontamination, op7_surrogates, op8_bit_packing, op9_tokeniser_fertility, op10_simhash_vantage_points)}


#: Windows of 50 words, the least id that each starts in, and the words that a window of an earlier document covers.
SQL_OP5 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM w),
k AS (SELECT doc_id, i, ws[i] word, CASE WHEN i + 49 <= len(ws) THEN array_to_string(ws[i:i + 49], ' ') END k FROM p),
f AS (SELECT k, min(doc_id) first FROM k WHERE k IS NOT NULL GROUP BY k),
d AS (SELECT k.doc_id, i, word, coalesce(f.first < k.doc_id, false) dup FROM k LEFT JOIN f ON k.k = f.k),
c AS (SELECT doc_id, i, word, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) gone FROM d),
g AS (SELECT doc_id, count(*) n, count(*) FILTER (WHERE gone) r, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') kept FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) n_words, coalesce(r, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; tests compare the other operators with brute force."""
    return {"op5_relative_lempel_ziv": SQL_OP5}
