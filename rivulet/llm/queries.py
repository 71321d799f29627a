"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, bpe, chat, codes, decontam, langid, matroska, negatives, sharding, simhash, sql, suffixes, toxicity, warc
from .batches import bound_batches
from .store import materialize


def prepare(spark: SparkSession) -> None:
    """Bounded batches, and this package's code where the workers run."""
    ship(spark)
    bound_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), True)


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat_pairs(chat.preference_pairs(table(spark, sf_dir, "conversations")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return bpe.round_trip(docs, ranks, pattern)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold_of(F.col("doc_id"), 4) != 2)
    found = langid.predict(docs, model)
    return found.select("doc_id", (langid.fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    merged = warc.histories(warc.read_archives(archives))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "capture_no")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return matroska.digests(matroska.packet_lists(materialize(matroska.mux(docs), "media")))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    """Labels are learned from the ids whose checksum modulo 5 is not 0, languages from the same documents."""
    learn = langid.fold_of(F.col("doc_id"), 5) != 0
    return toxicity.fit(docs, labels, learn, learn)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (langid.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "lang_pred")


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", shifted.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_spaced_seeds, op3_preference, op4_simhash, op5_byte_bpe, op6_language_id, op7_suffix_array, op8_warc, op9_matroska, op10_toxicity, op11_exponion, op12_hard_negatives, op13_cross_polytope)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    own = {"op1_sharding": sql.SHARDING, "op3_preference": sql.PREFERENCE, "op7_suffix_array": sql.REPEATS, "op8_warc": sql.ARCHIVES, "op11_exponion": sql.vector_codes(), "op12_hard_negatives": sql.NEGATIVES}
    return {name: text.strip() for name, text in own.items()}
