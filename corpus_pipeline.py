"""A corpus pipeline of the training-data operators: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import common, decontaminate, line_dedup, quality_rules, sentencepiece_viterbi, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the columns of ``docs``, the column ``text`` as their text, and its length."""
    made = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject, and the failed lines of the others."""
    return _with_text(docs, quality_rules.quality(docs).filter("kept"), "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs).filter("n_dropped = 0 or length(kept_text) > 0")
    return _with_text(docs, out, "kept_text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's text, and the digest of the text that they decode to."""
    out = sentencepiece_viterbi.encode_documents(docs)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_copies), ("decontamination", benchmark), ("sentencepiece", encoding)]

#: The fingerprints of the third stage are not expressible in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = common.stored(docs) if k < len(STAGES) - 1 else docs
    return docs
