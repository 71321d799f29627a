"""Model catalogues: tolerant JSON, lookups by several keys, percentiles of benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .analytics import midrank_percentile


# Patterns of slugs of models made for something else than text, of variants, and of aliases.
OTHER_KINDS = "(^|-)(audio|embedding|guard|image|moderation|omni|rerank|safety|speech|transcribe|tts|vision)(-|$)"
VARIANTS = "highspeed|latest|preview|turbo|ultraspeed"
ALIASES = "(-latest|-highspeed|-ultraspeed)$"


def number(json: str, path: str) -> Column:
    """A number at a path; any other type gives null."""
    return F.try_variant_get(F.try_parse_json(json), path, "double")


def models(documents: DataFrame, column: str = "document") -> DataFrame:
    """A row for each model of a catalogue document; fields of the wrong type are absent."""
    items = F.from_json(F.get_json_object(column, "$.models"), "array<string>")
    own = documents.select(F.explode(items).alias("m"))
    text = lambda p: F.nullif(F.get_json_object("m", p), F.lit(""))
    return own.select(
        text("$.id").alias("id"), text("$.name").alias("name"), slug(text("$.name")).alias("slug"),
        *[number("m", f"$.cost.{k}").alias(f"cost_{k}") for k in ("input", "output", "cacheRead", "cacheWrite")],
        F.from_json(F.get_json_object("m", "$.modalities.input"), "array<string>").alias("inputs"), F.from_json(F.get_json_object("m", "$.modalities.output"), "array<string>").alias("outputs"),
        F.from_json(F.get_json_object("m", "$.benchmarks"), "array<struct<name:string,score:double,harness:string>>").alias("benchmarks"),
    )


def feature_count(*lists: Column) -> Column:
    return F.size(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def benchmark_name(c: Column) -> Column:
    """Lower case, Greek tau and raised digits spelled out, without punctuation."""
    spelled = F.replace(F.translate(F.lower(c), "²³", "23"), F.lit("τ"), F.lit("tau"))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def best_scores(catalogue: DataFrame) -> DataFrame:
    """The best score of each model in each benchmark, with its percentile among models."""
    rows = catalogue.select("id", F.explode("benchmarks").alias("b")).select("id", benchmark_name(F.col("b.name")).alias("benchmark"), F.col("b.score").alias("score"))
    best = rows.filter("score is not null").groupBy("benchmark", "id").agg(F.max("score").alias("score"))
    return best.withColumn("percentile", midrank_percentile("score", ["benchmark"]))


def pivoted(submissions: DataFrame, document: str, tasks: list[str], k: int = 100) -> DataFrame:
    """Submissions' JSON documents, the newest k, as a row for each with a column for each task's score."""
    newest = submissions.orderBy(F.col("time_created").desc(), "id").limit(k)
    rows = newest.select("id", "time_created", F.explode(F.from_json(F.get_json_object(document, "$.tasks"), "array<struct<id:string,score:double>>")).alias("t"))
    return rows.select("id", "time_created", "t.*").toDF("id", "time_created", "task", "score").groupBy("id", "time_created").pivot("task", tasks).agg(F.max("score"))


def is_text_model(inputs: Column, outputs: Column, slug_: Column) -> Column:
    """Models that read and write text and are made for nothing else, by a word of their slug."""
    return F.coalesce(F.array_contains(inputs, "text") & F.array_contains(outputs, "text"), F.lit(False)) & ~slug_.rlike(OTHER_KINDS)


def family_order(preferred: list[str]) -> list[Column]:
    """Newest first, then preferred families in order, plain before variant names, short before long slugs, names."""
    family = F.array_position(F.array(*[F.lit(f) for f in preferred]).cast("array<string>"), slug(F.coalesce("family", F.lit(""))))
    place = F.when(family > 0, family - 1).otherwise(len(preferred))
    variant = F.col("slug").rlike(VARIANTS).cast("int")
    return [F.coalesce("release_date", "last_updated").desc_nulls_last(), place.asc(), variant.asc(), F.char_length("slug").asc(), F.col("name").asc()]


def without_aliases(models_: DataFrame) -> DataFrame:
    """Models less those whose slug is an alias ("-latest" and the like) of another of the same family and date."""
    alias = F.col("slug").rlike(ALIASES)
    plain = models_.filter(~alias).select(F.col("family").alias("__f"), F.col("release_date").alias("__d")).distinct()
    same = F.col("family").eqNullSafe(F.col("__f")) & F.col("release_date").eqNullSafe(F.col("__d"))
    return models_.filter(~alias).unionByName(models_.filter(alias).join(plain, same, "left_anti"))
