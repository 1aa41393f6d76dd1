"""Positions and running sums over a total order, in two levels.

A window without a partition puts every row in one task. Here rows are summed
in buckets that follow the order, a window runs over the sums alone (a row a
bucket), and each bucket adds what comes before it. ``bucket`` must not
decrease along ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _BEFORE = "__bucket", "__before"


def _before(rows: DataFrame, value: Column) -> DataFrame:
    sums = rows.groupBy(_BUCKET).agg(F.sum(value).alias("__sum"))
    over = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(_BUCKET, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias(_BEFORE))


def with_running_sum(rows: DataFrame, name: str, value: Column, bucket: Column, order: list, inclusive: bool = True) -> DataFrame:
    """rows with the sum of value over all rows up to each (or before it)."""
    rows = rows.withColumn(_BUCKET, bucket)
    over = Window.partitionBy(_BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.coalesce(F.sum(value).over(over), F.lit(0))
    return rows.withColumn(name, own).join(_before(rows, value), _BUCKET).withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_BUCKET, _BEFORE)


def with_index(rows: DataFrame, name: str, bucket: Column, order: list, ranks: dict[str, tuple[list[str], list]] | None = None) -> DataFrame:
    """rows with their place in the order, from 0.

    ranks: further places by name, each in groups (that don't go over a bucket)
    and an order; they share the shuffle, and the sort if they agree with it.
    """
    rows = rows.withColumn(_BUCKET, bucket)
    own = {name: F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*order))}
    own |= {k: F.row_number().over(Window.partitionBy(_BUCKET, *groups).orderBy(*line)) for k, (groups, line) in (ranks or {}).items()}
    placed = rows.select("*", *[(c.cast("long") - 1).alias(k) for k, c in own.items()])
    return placed.join(_before(rows, F.lit(1)), _BUCKET).withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_BUCKET, _BEFORE)


def with_rank(rows: DataFrame, name: str, group: str, order: str, width: int = 1 << 16) -> DataFrame:
    """rows with their place in their group, from 0. order: integers; a range of so many of them is ranked at once, so no group is one task's."""
    rows = rows.withColumn(_BUCKET, F.floor(F.col(order) / width))
    counts = rows.groupBy(group, _BUCKET).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias("__of"), F.col(_BUCKET).alias("__at"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias(_BEFORE))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(group, _BUCKET).orderBy(order)).cast("long") - 1)
    met = own.join(bases, F.col(group).eqNullSafe(F.col("__of")) & F.col(_BUCKET).eqNullSafe(F.col("__at")))
    return met.withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_BUCKET, _BEFORE, "__of", "__at")


def with_neighbours(rows: DataFrame, group: str, order: str, bucket: Column, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """rows with columns of the row before and after in their group: {new name: column}.

    Neighbours are sought within a group's buckets, which follow the order; then
    the first and last rows of buckets, two for each, meet in a window over the
    group. So a group with very many rows is as many tasks as it has buckets.
    """
    line = Window.partitionBy(group, _BUCKET).orderBy(order)
    inner = rows.withColumn(_BUCKET, bucket).select(
        "*",
        *[F.lag(c).over(line).alias(n) for n, c in before.items()],
        *[F.lead(c).over(line).alias(n) for n, c in after.items()],
        F.lag(F.lit(1)).over(line).isNull().alias("__first"),
        F.lead(F.lit(1)).over(line).isNull().alias("__last"),
    )
    over = Window.partitionBy(group).orderBy(order)
    found = {n: F.when(F.col("__first"), F.lag(c).over(over)).otherwise(F.col(n)) for n, c in before.items()}
    found |= {n: F.when(F.col("__last"), F.lead(c).over(over)).otherwise(F.col(n)) for n, c in after.items()}
    edges = inner.where("__first or __last").withColumns(found)
    return inner.where("not (__first or __last)").unionByName(edges).drop(_BUCKET, "__first", "__last")
