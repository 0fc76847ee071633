"""Joins with a rule: overrides, strict lookups, ordinal and interval joins, fallbacks, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overridden(base: DataFrame, overrides: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The base with ``column`` replaced where an override has a value."""
    fresh = overrides.select(*keys, F.col(column).alias("_fresh"))
    return base.join(fresh, keys, "left").withColumn(column, F.coalesce("_fresh", column)).drop("_fresh")


def strict(base: DataFrame, lookup: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The base with the looked-up column; a row without a partner is an error."""
    found = base.join(lookup.select(*keys, F.col(column).alias("_found")), keys, "left")
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    return found.withColumn(column, F.coalesce("_found", F.raise_error(F.concat(F.lit("no partner for "), name)).cast(dict(lookup.dtypes)[column]))).drop("_found")


def with_fallback(base: DataFrame, lookup: DataFrame, keys: list[str], column: str, valid: Column, fallback: Column) -> DataFrame:
    """The looked-up column where it is valid, else what the fallback computes."""
    found = base.join(lookup.select(*keys, column), keys, "left")
    return found.withColumn(column, F.coalesce(F.when(valid, F.col(column)), fallback))


def by_ordinal(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th of the left beside the k-th of the right within ``by``."""
    number = lambda frame, order: frame.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*by, "k"])


def within(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Points inside half-open spans of dates, joined on cells of ``width`` days: an equi-join, no nested loop."""
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    cut_spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    joined = points.withColumn("_cell", cell(F.col(at))).join(cut_spans, [*(by or []), "_cell"])
    return joined.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def sessions(lines: DataFrame, start: Column, by: list[str], order: str) -> DataFrame:
    """The lines with ``block``: the number of the last start at or before them; lines before the first have 0."""
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(start.cast("bigint")).over(running))


def nearest_markers(lines: DataFrame, marker: Column, by: list[str], order: str) -> DataFrame:
    """The lines with the nearest marker line before them (``before``) and after them (``after``), by order."""
    at = F.when(marker, F.col(order))
    w = Window.partitionBy(*by).orderBy(order)
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumns({"before": before, "after": after})
