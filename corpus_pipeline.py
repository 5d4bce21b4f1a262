"""Cleaning of a training corpus, stage by stage, with the operators of rollbook.llm.

Each stage takes the table of documents that the one before it wrote and returns one with the same columns; the
last returns packed pieces. Tables that a stage needs besides are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import fertility, neardup, packing, secrets, tiling
from rollbook.sources.shared import forget, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility bands of their language, which all good labelled ones set.

    Texts are measured once: the result reads a table of them with their measures, which ``run`` deletes afterwards.
    """
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    measured = written(fertility.measure(docs), "measured")
    kept = fertility.kept(measured, fertility.learn(measured, good))
    kept.scratch = measured.scratch
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): see ``neardup.keep_one``.

    Groups are of rows, so neither repeated nor null ids lose a text that is no near copy of a kept one.
    """
    return neardup.keep_one(docs, percent=80, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return tiling.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("secret_scans", redact_secrets), ("best_fit_packing", pack)]

#: Tokenisers and fertility bands have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = written(out, name)
        if "scratch" in vars(out):
            forget(out)
    return STAGES[-1][1](spark, docs, sf_dir)
