"""Usage rollups: normalise request events, aggregate all dimensions and grains in one pass, collapse, add all-tier rows, rank."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..session import written

# Which part of a model's name tells its author, in order of precedence; suffixes that are no part of a
# name; models that are not counted.
AUTHORS = (
    ("claude", "anthropic"), ("gemini", "google"), ("deepseek", "deepseek"), ("glm", "zhipu"), ("gpt", "openai"), ("grok", "xai"),
    ("hy3", "tencent"), ("kimi", "moonshot"), ("mimo", "xiaomi"), ("minimax", "minimax"), ("nemotron", "nvidia"), ("qwen", "qwen"),
)
SUFFIXES = ("-free", ":global")
EXCLUDED = ("alpha-gpt-next",)


@dataclass(frozen=True)
class Rules:
    """Names that stand for another model or provider; which tiers a request can have."""

    authors: tuple[tuple[str, str], ...] = AUTHORS
    suffixes: tuple[str, ...] = SUFFIXES
    excluded: tuple[str, ...] = EXCLUDED
    retired_models: tuple[str, ...] = ()
    retired_providers: tuple[str, ...] = ()
    free_models: tuple[str, ...] = ()
    source_tiers: tuple[tuple[str, str], ...] = field(default=(("lite", "Go"),))

    def name(self, model: Column) -> Column:
        return text.strip_suffixes(model, self.suffixes)

    def model(self, model: Column, provider_model: Column) -> Column:
        """A retired name gives way to the name that the provider uses."""
        own = self.name(model)
        return F.when(F.lower(own).isin(*self.retired_models), self.name(provider_model)).otherwise(own) if self.retired_models else own

    def author(self, model: Column) -> Column:
        """Null for a model that is not counted."""
        return self.author_of(F.lower(self.name(model)))

    def author_of(self, own: Column) -> Column:
        return F.when(~own.isin(*self.excluded), text.first_match(own, self.authors))

    def provider(self, model: Column, provider_model: Column, provider: Column) -> Column:
        """The author by the provider's name, then by the model's, then the provider itself, then "unknown"; null if not counted."""
        return self.provider_of(self.author(self.model(model, provider_model)), self.author(provider_model), provider)

    def provider_of(self, by_model: Column, by_backend: Column, provider: Column) -> Column:
        known = lambda c: F.when(c != "unknown", c)
        own = F.nullif(provider, F.lit(""))
        if self.retired_providers:
            own = F.when(~F.lower(own).isin(*self.retired_providers), own)
        return F.when(by_model.isNotNull(), F.coalesce(known(by_backend), known(by_model), own, by_model))

    def resolved(self, rows: DataFrame) -> DataFrame:
        """``rows`` with __model and __provider. Names are made step by step, as one expression would repeat each in the next."""
        lower = lambda c: F.lower(self.name(F.col(c)))
        out = rows.withColumns({"__name": self.name(F.col("model")), "__backend": self.name(F.col("provider_model"))})
        own = F.col("__name")
        out = out.withColumn("__model", F.when(F.lower(own).isin(*self.retired_models), F.col("__backend")).otherwise(own) if self.retired_models else own)
        out = out.withColumns({"__low": lower("__model"), "__low_backend": lower("provider_model")})
        out = out.withColumns({"__by_model": self.author_of(F.col("__low")), "__by_backend": self.author_of(F.col("__low_backend"))})
        return out.withColumn("__provider", self.provider_of(F.col("__by_model"), F.col("__by_backend"), F.col("provider")))

    def tier(self, source: Column, model: Column) -> Column:
        out = None
        for value, tier in self.source_tiers:
            out = F.when(source == value, tier) if out is None else out.when(source == value, tier)
        free = model.rlike("-free(:global)?$") | (model.isin(*self.free_models) if self.free_models else F.lit(False))
        out = F.when(free, "Free") if out is None else out.when(free, "Free")
        return out.otherwise("Paid")


def normalized(events: DataFrame, start: str, end: str, rules: Rules = Rules(), source: str | None = "lite") -> DataFrame:
    """Counted requests of a half-open period of ISO timestamps (as text), with derived measures.

    The bounds on event_date repeat those on event_timestamp, so that a table partitioned by date is pruned.
    """
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit(""))
    rows = events.filter((c("event_type") == "completions") & (c("model") != "") & (c("event_date") >= start[:10]) & (c("event_date") <= end[:10]) & (c("event_timestamp") >= start) & (c("event_timestamp") < end))
    if source is not None:
        rows = rows.filter(c("source") == source)
    span = c("timestamp_last_byte") - c("timestamp_first_byte")
    micro = {f"cost_{k}_microcents": numbers.micro_or_cents(c(f"cost_{k}_microcents"), c(f"cost_{k}")) for k in ("input", "output", "total")}
    kinds = ("cache_read", "cache_write_5m", "cache_write_1h", "input", "output")
    out = rules.resolved(rows).select(
        F.to_timestamp("event_timestamp").alias("event_time"),
        rules.tier(c("source"), c("model")).alias("tier"),
        c("__provider").alias("provider"),
        blank("provider_model").alias("provider_model"),
        c("__model").alias("model"),
        F.upper(text.or_default(c("cf_country"), "ZZ")).alias("country"),
        blank("cf_continent").alias("continent"),
        "session",
        F.coalesce(*[F.nullif(c(k), F.lit("")) for k in ("user_id", "workspace", "api_key")]).alias("user_key"),
        "status",
        c("duration").alias("duration_ms"),
        c("time_to_first_byte").alias("ttfb_ms"),
        F.when(span >= 100, c("tokens_output").cast("double") / span * 1000).alias("output_tps"),
        *[f"tokens_{k}" for k in ("input", "output", "reasoning", "cache_read")],
        reduce(lambda a, b: a + b, [F.coalesce(c(f"tokens_{k}"), F.lit(0)) for k in kinds]).alias("tokens_total"),
        *[v.alias(k) for k, v in micro.items()],
    )
    return out.filter(~F.lower("model").isin(*rules.excluded)) if rules.excluded else out


#: Counts that are added when rows are merged; among them distinct counts: a merged row's is a sum of distincts.
ADDED = ("sessions", "requests", "unique_users", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "total_tokens", "input_cost_microcents", "output_cost_microcents", "total_cost_microcents", "success_count", "error_count", "sample_count")
AVERAGED = ("avg_duration_ms", "avg_ttfb_ms", "avg_output_tps")
PERCENTILES = ("p50_duration_ms", "p95_duration_ms", "p50_ttfb_ms", "p95_ttfb_ms")


#: Size of the percentile sketches: a rank error of some 0.4 %, whatever the number of requests.
SKETCH = 800
SKETCHED = ("duration_ms", "ttfb_ms")
#: Ranks between which the exact percentiles are looked for first, and the size of the sketches that give the values there.
EDGES, EDGE_SKETCH = (0.49, 0.51, 0.94, 0.96), 400
_KEYS = ("week_key", "day_key", "tier", "provider", "model", "country")
_SETS = tuple((grain, *dims) for grain in ("week_key", "day_key") for dims in (("tier", "provider", "model"), ("tier", "provider"), ("tier", "country"), ("tier", "provider", "model", "country")))


def _periods(rows: DataFrame) -> DataFrame:
    return rows.select(dates.iso_week_id(F.col("event_time")).alias("week_key"), dates.day_key(F.col("event_time")).alias("day_key"), "*")


def _by_sets(rows: DataFrame, *measures: Column) -> DataFrame:
    """The measures of both grains and four dimensions: week or day, by tier and (provider, model), provider, country, or all of them."""
    c = F.col
    on = lambda k: F.grouping(k) == 0
    out = rows.groupingSets([[c(k) for k in s] for s in _SETS], *map(c, _KEYS)).agg(
        F.when(on("week_key"), "week").otherwise("day").alias("grain"),
        F.coalesce("week_key", "day_key").alias("period_key"),
        F.when(on("country") & on("model"), "geo_model").when(on("country"), "geo").when(on("model"), "model").otherwise("provider").alias("dimension"),
        F.when(on("provider"), c("provider")).otherwise("all").alias("provider_label"),
        F.when(on("model"), c("model")).when(on("country"), "all").alias("model_label"),
        F.when(on("country"), c("country")).alias("country_label"),
        *measures,
    )
    return out.drop("week_key", "day_key", "provider", "model", "country").withColumnsRenamed({f"{k}_label": k for k in ("provider", "model", "country")})


def _labels() -> list[Column]:
    """The provider's name for a model, and the continent of a country: the last in order of those that occur."""
    some = lambda k: F.coalesce(F.max(F.nullif(F.col(k), F.lit(""))), F.lit(""))
    on = lambda k: F.grouping(k) == 0
    return [F.when(on("model") & ~on("country"), some("provider_model")).alias("provider_model"), F.when(on("country"), some("continent")).alias("continent")]


#: What identifies a row of the eight sets.
SET_KEYS = ("grain", "period_key", "dimension", "tier", "provider", "model", "country")


def _place(keys: tuple[str, ...]) -> list[Column]:
    """:data:`SET_KEYS` of a request in the set of ``keys``."""
    label = lambda k: F.col(k) if k in keys else F.lit("all" if k == "provider" or (k == "model" and "country" in keys) else None).cast("string")
    dimension = "geo_model" if {"country", "model"} <= set(keys) else "geo" if "country" in keys else "model" if "model" in keys else "provider"
    return [F.lit(keys[0][:-4]).alias("grain"), F.col(keys[0]).alias("period_key"), F.lit(dimension).alias("dimension"), F.col("tier"), *[label(k).alias(k) for k in ("provider", "model", "country")]]


def _spread(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The sketched measures of each request once a set, beside the row of ``own`` (:data:`SET_KEYS` and more) for its group there."""
    values = [F.col(k).cast("double").alias(k) for k in SKETCHED]
    spread = _periods(rows).select(F.explode(F.array(*[F.struct(*_place(s)) for s in _SETS])).alias("at"), *values).select(*[F.col(f"at.{k}").alias(f"__{k}") for k in SET_KEYS], *SKETCHED)
    return spread.join(own, reduce(lambda a, b: a & b, [F.col(f"__{k}").eqNullSafe(F.col(k)) for k in SET_KEYS]))


def _sketches(size: int) -> list[Column]:
    return [F.expr(f"kll_sketch_agg_double(cast({k} as double), {size})").alias(f"kll_{k}") for k in SKETCHED]


def _merged_sketches(size: int) -> list[Column]:
    return [F.expr(f"kll_merge_agg_double(kll_{k}, {size})").alias(f"kll_{k}") for k in SKETCHED]


def _sketched(k: str, rank: float) -> Column:
    return F.when(F.expr(f"kll_sketch_get_n_double(kll_{k})") > 0, F.expr(f"kll_sketch_get_quantile_double(kll_{k}, {rank}d)"))


def grouped(rows: DataFrame, dataset: str, exact: bool = False) -> DataFrame:
    """Both grains and four dimensions, with all measures.

    Sums, counts and percentile sketches are made once, in the finest group, and merged up the sets. Distinct sessions and
    users are counted over the distinct pairs of finest group and session (or user), so a request is not sent once a set.
    ``exact`` takes :func:`exact_percentiles` instead of the sketches' own.
    """
    periods, count = _periods(rows), F.count(F.lit(1))
    whole = {f"tokens_{k}": f"{k}_tokens" for k in ("input", "output", "reasoning", "cache_read", "total")} | {f"cost_{k}_microcents": f"{k}_cost_microcents" for k in ("input", "output", "total")}
    means = (*SKETCHED, "output_tps")
    base = periods.groupBy(*_KEYS).agg(
        count.alias("n"), F.count_if((F.col("status") >= 200) & (F.col("status") < 400)).alias("good"), F.count_if(F.col("status") >= 400).alias("bad"),
        *[F.max(F.nullif(F.col(k), F.lit(""))).alias(k) for k in ("provider_model", "continent")],
        *[F.sum(k).alias(k) for k in whole],
        *[x for k in means for x in (F.sum(k).alias(f"sum_{k}"), F.count(k).alias(f"n_{k}"))],
        *([] if exact else _sketches(SKETCH)),
    )
    total = lambda k, name: F.coalesce(F.sum(k), F.lit(0)).alias(name)
    own = _by_sets(
        base, *_labels(), total("n", "requests"), *[total(k, name) for k, name in whole.items()],
        *[F.try_divide(F.sum(f"sum_{k}"), F.sum(f"n_{k}")).alias(f"avg_{k}") for k in means],
        total("good", "success_count"), total("bad", "error_count"), total("n", "sample_count"),
        *([] if exact else _merged_sketches(SKETCH)),
    )
    if not exact:
        own = own.withColumns({f"p{q}_{k}": _sketched(k, q / 100) for k in SKETCHED for q in (50, 95)}).drop(*[f"kll_{k}" for k in SKETCHED])
    parts = [own, exact_percentiles(rows)] if exact else [own]
    for k, name in (("session", "sessions"), ("user_key", "unique_users")):
        parts.append(_by_sets(periods.select(*_KEYS, k).distinct(), F.count_distinct(k).alias(name)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in both.columns if c not in SET_KEYS]
    return both.groupBy(*SET_KEYS).agg(*[F.max(c).alias(c) for c in rest]).withColumn("dataset", F.lit(dataset))


def exact_percentiles(rows: DataFrame) -> DataFrame:
    """:data:`SET_KEYS` and the exact, interpolated :data:`PERCENTILES` of every group of the eight sets.

    Sketches name values around each percentile, and counting all requests up to those values tells between which of them
    it lies. Only what lies there is sorted, by ranges, so that no group is in one task. A poor sketch makes more to sort,
    not another result.
    """
    c, edges = F.col, [(k, j) for k in SKETCHED for j in range(len(EDGES))]
    near = _by_sets(_periods(rows).groupBy(*_KEYS).agg(*_sketches(EDGE_SKETCH)), *_merged_sketches(EDGE_SKETCH))
    near = near.select(F.monotonically_increasing_id().alias("id"), *SET_KEYS, *[_sketched(k, EDGES[j]).alias(f"{k}_{j}") for k, j in edges])
    near = written(near, "percentile-edges")  # sketches are random: what is counted and what is sorted must be cut at the same values
    upto = [F.count_if(c(k) <= c(f"{k}_{j}")).alias(f"upto_{k}_{j}") for k, j in edges]
    counts = _spread(rows, near).groupBy("id").agg(*[F.count(k).alias(f"n_{k}") for k in SKETCHED], *upto).join(near, "id")

    def around(k: str, q: int) -> Column:
        """Where the percentile stands (from 0), the edges that its neighbours are between, and how many values are up to the lower edge."""
        place = (c(f"n_{k}") - 1) * F.lit(q / 100)
        before = lambda x: F.greatest(*[F.when(c(f"upto_{k}_{j}") <= F.floor(place), x(j)) for j in range(len(EDGES))])
        after = F.least(*[F.when(c(f"upto_{k}_{j}") > F.ceil(place), c(f"{k}_{j}")) for j in range(len(EDGES))])
        return F.struct(place.alias("place"), before(lambda j: c(f"{k}_{j}")).alias("over"), after.alias("upto"), F.coalesce(before(lambda j: c(f"upto_{k}_{j}")), F.lit(0)).alias("skip"))

    names = {f"p{q}_{k}": (k, q) for k in SKETCHED for q in (50, 95)}
    wanted = written(counts.select("id", *SET_KEYS, *[around(k, q).alias(name) for name, (k, q) in names.items()]), "percentile-places")
    inside = {name: c(k).isNotNull() & (c(f"{name}.over").isNull() | (c(k) > c(f"{name}.over"))) & (c(f"{name}.upto").isNull() | (c(k) <= c(f"{name}.upto"))) for name, (k, _) in names.items()}
    found = _spread(rows, wanted).filter(reduce(lambda a, b: a | b, inside.values()))
    found = found.select("id", F.explode(F.array(*[F.when(inside[name], F.struct(F.lit(name).alias("name"), c(f"{name}.skip").alias("skip"), c(f"{name}.place").alias("place"), c(k).alias("value"))) for name, (k, _) in names.items()])).alias("at"))
    found = found.filter("at IS NOT NULL").select("id", "at.*").groupBy("id", "name", "skip", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    part = written(found.repartitionByRange("id", "name", "value").withColumn("part", F.spark_partition_id()), "percentile-values")
    earlier = Window.partitionBy("id", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("id", "name", "part").agg(F.sum("n").alias("size")).select("id", "name", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("id", "name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = part.withColumn("here", F.sum("n").over(here)).join(sizes, ["id", "name", "part"]).withColumn("upto", c("skip") + c("earlier") + c("here"))
    least = lambda at: F.min(F.when(c("upto") > at(c("place")), c("value")))
    both = upto.groupBy("id", "name", "place").agg(least(F.floor).alias("low"), least(F.ceil).alias("high"))
    share = c("place") - F.floor("place")
    value = F.when(c("low") == c("high"), c("low")).otherwise(c("low") * (1 - share) + c("high") * share)
    values = both.groupBy("id").agg(*[F.max(F.when(c("name") == name, value)).alias(name) for name in names])
    return wanted.select("id", *SET_KEYS).join(values, "id", "left").select(*SET_KEYS, *names)


def percentile_ranks(rows: DataFrame, estimates: DataFrame, error: float = 0.01) -> DataFrame:
    """For each row of ``estimates`` (:data:`SET_KEYS` and percentiles) whether each percentile's rank among its requests is within ``error``."""
    tags = [F.when(F.col(name).isNotNull(), (F.count_if(F.col(k) < F.col(name)) / F.count(k) - error <= q / 100) & (F.count_if(F.col(k) <= F.col(name)) / F.count(k) + error >= q / 100)).alias(f"{name}_ok") for k in SKETCHED for q in (50, 95) for name in (f"p{q}_{k}",)]
    names = [f"p{q}_{k}" for k in SKETCHED for q in (50, 95)]
    return _spread(rows, estimates.select(*SET_KEYS, *names)).groupBy(*SET_KEYS, *names).agg(*tags).drop(*names)


def merged(rows: DataFrame, keys: list[str], added: tuple[str, ...] = ADDED, averaged: tuple[str, ...] = AVERAGED, percentiles: tuple[str, ...] = PERCENTILES, weight: str = "requests") -> DataFrame:
    """Merge rows of a key: counts add up, averages are weighted by requests, percentiles are lost unless the row is alone."""
    alone = F.count(F.lit(1)) == 1
    return rows.groupBy(*keys).agg(
        *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in added],
        *[F.when(alone, F.max(n)).otherwise(numbers.weighted_mean(F.col(n), F.col(weight))).alias(n) for n in averaged],
        *[F.when(alone, F.max(n)).alias(n) for n in percentiles],
    )


def with_all_tier(rows: DataFrame, keys: list[str], **how) -> DataFrame:
    """The rows, and for each key without its tier a merged row of tier "all"."""
    total = merged(rows, [k for k in keys if k != "tier"], **how).withColumn("tier", F.lit("all"))
    return rows.unionByName(total.select(*rows.columns))


def ranked(rows: DataFrame, partition: list[str], metrics: dict[str, str], tie: list[str]) -> DataFrame:
    """Row numbers by descending metric (no shared ranks; ties by ``tie``) and shares of the partition's total (six places, null if it is not positive)."""
    whole = Window.partitionBy(*partition)
    out = rows
    for name, metric in metrics.items():
        order = whole.orderBy(F.col(metric).desc(), *tie)
        out = out.withColumn(f"rank_by_{name}", F.row_number().over(order)).withColumn(f"{name}_share", numbers.ratio(F.col(metric), F.sum(metric).over(whole)))
    return out
