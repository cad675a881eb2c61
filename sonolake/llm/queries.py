"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, embeddings, langid, licenses, mixing, ngrams, paragraphs, simhash, substrings, warc


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scores(spark, sf_dir):
    return ngrams.score(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    got = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark, sf_dir):
    return paragraphs.duplicated_documents(_read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_embeddings": op9_embeddings,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {"op2_suffix_dedup": substrings.oracle(), "op8_mixing": mixing.oracle()}
