"""From raw documents to a training mix: each stage reads what its predecessor kept.

Every stage but the last returns the columns of ``documents``, and any further ones as they are, whatever their names;
the last returns the selections of the mix.  In all stages a null text is empty, rows without an id are rows like
others unless said otherwise, a text of any length is read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.llm import decontam, langid, mixing, simhash, substrings
from sonolake.llm.common import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, or under the calibrated score, go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, of equal rows the first; rows without an id stay."""
    return simhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller id holds; documents of which no word is left go."""
    names = docs.columns
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "n_chars") if c in names}
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    other = [c for c in plain.columns if c not in (at["text"], at.get("n_chars"))]
    got = substrings.remove_repeats(plain.select("*", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), other, characters=True)
    got = got.withColumn(at["text"], F.col("kept").cast("string")).where(f"n_removed = 0 OR {at['text']} RLIKE '[^ \\\\x09-\\\\x0D]'")
    if "n_chars" in at:
        got = got.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return got.select(*plain.columns).toDF(*names)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaked."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selections that meet the target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: SQL can express neither the classifier nor the suffix stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
