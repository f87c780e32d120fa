"""Corpus pipeline: clean, deduplicate, mix and pack `documents`."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from panelrd.llm import langid, line_dedup, minhash, mixing, packing  # noqa: E402
from panelrd.llm.common import ship_package, table, written  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go (no letters, or far from every language's centroids)."""
    ship_package(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).filter("NOT _lang_rejected").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates (n_chars follows); one that loses all its words goes."""
    ship_package(spark)
    found = line_dedup.dedup_lines(docs, short_lines=True)
    cut = F.col("_n_removed") > 0
    found = found.filter(~cut | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    found = found.withColumn("text", F.col("_kept")).withColumn("n_chars", F.when(cut, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix draws it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.op4_best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language identification, near-duplicates and tokenisation are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
