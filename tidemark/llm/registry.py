"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, hmm, linededup, mixing, ngramjoin, oracles, quotes, secrets, topk, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "order_key")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return hmm.score_texts(_table(spark, sf_dir, "documents"), held_out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.Ledger(spark).scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_ngram_join": op2_ngram_join, "op3_hmm_score": op3_hmm_score, "op4_line_dedup": op4_line_dedup, "op5_quote_links": op5_quote_links, "op6_toxicity": op6_toxicity, "op7_secret_scan": op7_secret_scan, "op8_url_filter": op8_url_filter, "op9_topk": op9_topk, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    """The other queries have models or hashes that SQL lacks; tests compare them with brute force."""
    return {
        "op1_mixing": oracles.mixing(),
        "op2_ngram_join": oracles.ngram_join(4, 85, 100),
        "op4_line_dedup": linededup.ORACLE,
        "op5_quote_links": oracles.QUOTES,
        "op7_secret_scan": secrets.oracle(),
        "op8_url_filter": oracles.url_filter(),
        "op9_topk": oracles.TOPK,
    }
