"""The corpus pipeline: language identification, near-duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns the columns of
documents; the last one returns the digests read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, langid, minhash, mixing, tokens
from dossier.llm.common import bitmap, maybe_in, new_path, save, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows and keeps what is written in a learnt language; lang stays as it was."""
    return langid.keep_known(docs, langid.learn(docs)).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    path = new_path(spark, "near")
    save(minhash.components(docs, k=5, percent=80).where("not kept").select("doc_id").distinct(), path)
    gone = spark.read.schema("doc_id long").parquet(path)
    rows = docs.withColumn("__maybe", maybe_in(spark, bitmap(gone.select(F.xxhash64("doc_id").alias("h")), "h"))(F.xxhash64("doc_id")))
    kept = rows.where("__maybe").join(gone, "doc_id", "left_anti").select(COLUMNS)
    return kept.union(rows.where("not __maybe").select(COLUMNS))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are drawn: 150 % of all words, sources weighing 3, 1, 2, none over twice its size."""
    return mixing.sample(docs.select(COLUMNS))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_leaks),
    ("mix", mixed),
    ("tokens", token_files),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        save(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
