"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanespark.llm import bpe, embdedup, fingerprint, langid, linededup, lmscore, mixing, secretscan, simhash, urlfilter
from vanespark.tables import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=2)
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_deleted", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(_table(spark, sf_dir, "documents"))


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "domain", "lang", "source", "tokens", "copies")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lmscore.score(_table(spark, sf_dir, "documents"))  # score: the mean over the words, which compares documents of any length
    return out.select("doc_id", "n_words", F.col("mean_log_score").alias("score"), F.col("log_score").alias("log_sum"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = new_path(spark, "ledger")
    secretscan.update(docs, ledger)
    return secretscan.digest_columns(secretscan.update(docs, ledger))  # the second scan finds every blob in the ledger


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_encode_decode": op1_bpe_encode_decode,
        "op2_url_filters": op2_url_filters,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_mix_to_weights": op7_mix_to_weights,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_secret_scans": op9_secret_scans,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": urlfilter.oracle_sql(),
        "op4_line_dedup": linededup.oracle_sql(),
        "op7_mix_to_weights": mixing.oracle_sql(),
    }
