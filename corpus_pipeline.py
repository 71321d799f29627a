"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``; rows whose doc_id is null are documents
like any other, and a stage's defined results are those of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, copies, decontam, store, suffixes
from rivulet.llm.queries import prepare, table, toxicity_model
from rivulet.llm.toxicity import reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, predicts toxic go."""
    prepare(spark)
    return reject(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies (similarity of five-word shingles of 0.8 or more) the smallest doc_id's row stays."""
    prepare(spark)
    return copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 100 bytes or more that an earlier document has are cut; n_chars follows the text."""
    prepare(spark)
    columns = docs.columns
    clean = suffixes.cleaned(suffixes.remove_repeats(docs), columns)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else clean


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    prepare(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number and digest of the ids, and the digest of the bytes decoded from them."""
    prepare(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return bpe.round_trip(docs, ranks, pattern)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Trained classifiers, XXH64 fingerprints and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
