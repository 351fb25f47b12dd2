"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import decontam, langid, linededup, minhash, packing, quality, revisit, rules, runindex, toxicity
from textsieve.llm.sampling import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens; a null text is empty, and rows without a doc_id are packed too."""
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document; a null or empty text is its own class, and a null doc_id has a null one."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from rows that aren't held out; null texts and those without a letter are `und`."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, source, digest and headers of a capture of every page."""
    return revisit.page_report(_read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a hash of what is left of every text; a null text has no lines and counts as empty in the hash."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = linededup.dedup_lines(docs.withColumn("n_lines", n_lines), least=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every text; null texts have no words."""
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, runs and a hash of what is left of every text; a null text is empty."""
    return runindex.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from rows that aren't held out; a null or empty text has the score of no evidence."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from rows that aren't held out; a null or empty text has the score of no features."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text; a null text has no words, and so fails."""
    docs = _read(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fit(docs, _read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_langid": op3_langid,
    "op4_revisits": op4_revisits,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_repeats": op7_repeats,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_rules": op10_rules,
}

#: Queries that DuckDB can express.
ORACLES: dict[str, str] = {"op4_revisits": revisit.ORACLE, "op6_decontamination": decontam.ORACLE, "op7_repeats": runindex.ORACLE}
