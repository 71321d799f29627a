"""Window operators: running sums, percentile ranks, latest rows, differences, gaps, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_rank(partition: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def running_sum(value: Column, partition: list[str], *order, inclusive: bool = True) -> Column:
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def effective_budget(budget: Column, spent: Column, partition: list[str], *order) -> Column:
    """What rows before this one have left of a budget."""
    return F.greatest(F.lit(0), budget - running_sum(spent, partition, *order, inclusive=False))


def budget_by_priority(rows: DataFrame, key: str, budget: str, current: str, previous: str, priority: str = "priority", prefer_below: float = 0.8) -> DataFrame:
    """Providers' spend through each priority against their budget.

    The first priority always qualifies; a later one if the current spend through it is below what the previous
    window's earlier priorities left. A priority is preferred while the previous spend through it is below a share of the budget.
    """
    order = (priority,)
    out = rows.withColumns({
        "effective_budget": effective_budget(F.col(budget), F.col(previous), [key], *order),
        "spent_through": running_sum(F.col(current), [key], *order),
        "previous_through": running_sum(F.col(previous), [key], *order),
    })
    return out.withColumns({
        "qualifies": (F.col(priority) <= 1) | (F.col("spent_through") < F.col("effective_budget")),
        "preferred": F.col("previous_through") < F.col(budget) * prefer_below,
    })


def midrank_percentile(value: str, partition: list[str], higher_is_better: bool = True) -> Column:
    """(below + (equal - 1) / 2) / (n - 1) * 100; null where a group has one value only or the value is null."""
    whole = Window.partitionBy(*partition)
    peers = F.count(value).over(Window.partitionBy(*partition, value))
    order = F.col(value).asc_nulls_last() if higher_is_better else F.col(value).desc_nulls_last()
    below = F.rank().over(whole.orderBy(order)) - 1
    n = F.count(value).over(whole)
    return F.when(F.col(value).isNotNull() & (n > 1), (below + (peers - 1) / 2) / (n - 1) * 100)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a map-side aggregation, so no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def change(value: str, partition: list[str], *order) -> Column:
    """Difference to the row before."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))


def gaps(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows whose sequence number does not follow the one before (the first of a key must be 0)."""
    order = Window.partitionBy(key).orderBy(seq)
    expected = F.coalesce(F.lag(seq).over(order) + 1, F.lit(0))
    return rows.withColumn("expected", expected).filter(F.col(seq) != F.col("expected"))


def max_normalized(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the share of the table's largest value; 0 if that is not positive. The maximum is one row, sent to all tasks."""
    top = rows.agg(F.max(value).alias("__top"))
    return rows.join(F.broadcast(top)).withColumn(name, F.when(F.col("__top") > 0, F.col(value) / F.col("__top")).otherwise(F.lit(0.0))).drop("__top")


def newest_within(rows: DataFrame, key: str, seq: str, text: str, cost: Column, budget: int, per_char: int = 4) -> DataFrame:
    """From the newest row back, rows until a budget is spent; the row that crosses it keeps its last characters."""
    order = Window.partitionBy(key).orderBy(F.col(seq).desc())
    before = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumns({"__cost": cost, "__before": before}).filter(F.col("__before") < budget)
    room = (F.lit(budget) - F.col("__before")) * per_char
    whole = F.col("__before") + F.col("__cost") <= budget
    cut = F.when(whole, F.col(text)).otherwise(F.substr(F.col(text), F.greatest(F.lit(1), F.char_length(text) - room + 1).cast("int")))
    return out.withColumn("kept", cut).withColumn("is_cut", ~whole).drop("__cost", "__before")


def top_per_group(rows: DataFrame, partition: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each group. Spark prunes each task's rows to k a group before it shuffles them."""
    return rows.withColumn("__no", row_rank(partition, *order)).filter(F.col("__no") <= k).drop("__no")


def with_total(rows: DataFrame, key: str, measures: dict[str, Column], label: str = "TOTAL") -> DataFrame:
    """Aggregates by a key and a grand total row, in one pass."""
    return rows.rollup(key).agg(F.grouping(key).alias("__total"), *[v.alias(k) for k, v in measures.items()]).select(F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col(key).cast("string")).alias(key), *measures)


def recent(rows: DataFrame, ident: str, updated: str, limit: int, cutoff) -> DataFrame:
    """The newest rows after a cutoff, one for each id, ties by id; a top-k sort."""
    own = first_by(rows.filter(F.col(ident).isNotNull() & (F.col(updated) > cutoff)), [ident], [updated])
    return own.orderBy(F.col(updated).desc(), ident).limit(limit)


def sample(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random rows; a top-k sort, so each task keeps n."""
    return rows.orderBy(F.rand(seed)).limit(n)
