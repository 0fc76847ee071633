"""Exact duplicates, groups that merge, renumbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import squash, squeeze
from tallyloom.session import cut


def composite_key(stem: Column, a: Column, b: Column, most: int = 200) -> Column:
    """Stem and two options in lower case, joined by bars, white space squeezed, the first ``most`` characters."""
    return F.left(squeeze(F.lower(F.concat_ws("|", F.coalesce(stem, F.lit("")), F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), F.lit(most))


def flagged(items: DataFrame, key: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """The items with ``is_duplicate``: a non-empty key that an earlier item has.

    The first of each key comes from a pre-aggregated minimum, not a window, so a key that a third of all
    rows share is no hot task.
    """
    by = by or []
    keyed = items.withColumn("_key", F.coalesce(key, F.lit("")))
    first = keyed.where("_key <> ''").groupBy(*by, "_key").agg(F.min(order).alias("_first"))
    joined = keyed.join(first, [*by, "_key"], "left")
    return joined.withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_key", "_first")


def deduped(items: DataFrame, stem: str, order: str, by: list[str] | None = None) -> DataFrame:
    return flagged(items, squash(F.col(stem)), order, by).where("not is_duplicate").drop("is_duplicate")


def against_accepted(fresh: DataFrame, accepted: DataFrame, stem: str, order: str, most: int = 160) -> DataFrame:
    """Fresh items whose key is neither among the accepted nor on an earlier fresh item."""
    key = F.left(squash(F.col(stem)), F.lit(most))
    known = accepted.select(key.alias("_known")).where("_known <> ''").distinct()
    open_ = fresh.withColumn("_known", F.coalesce(key, F.lit(""))).join(known, "_known", "left_anti")
    return flagged(open_, F.col("_known"), order).where("not is_duplicate").drop("is_duplicate", "_known")


def numbered(items: DataFrame, order: str, by: list[str]) -> DataFrame:
    """The items with ``ordinal`` 1 to N within ``by``, in order; ties by all other columns that can be sorted.

    Rows are sorted into ranges of (by, order); a row's number is the count of its group in the ranges before, plus its
    place in its range. So a group that holds a third of all rows is spread over as many tasks as its share of rows.
    """
    ranged = items.repartitionByRange(*[F.col(c) for c in [*by, order]]).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_before")
    ties = [c for c, kind in items.dtypes if c not in (*by, order) and not kind.startswith(("map", "variant"))]
    place = F.row_number().over(Window.partitionBy("_range", *by).orderBy(order, *ties))
    same = (F.col("_range") == F.col("_of")) & reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    return ranged.withColumn("_place", place).join(offsets, same).select(*items.columns, (F.col("_before") + F.col("_place")).alias("ordinal"))


def renumbered(items: DataFrame, order: str, by: list[str]) -> DataFrame:
    """The items with new_number 1 to N within ``by``, in order."""
    return numbered(items, order, by).withColumn("ordinal", F.col("ordinal").cast("int")).withColumnRenamed("ordinal", "new_number")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the least node of each connected component of (a, b), by alternating large and small stars.

    Each round hooks every node to the least neighbour it knows; the number of rounds grows with the
    logarithm of the longest path. Lineage is cut every round; only the count of changes reaches the driver.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")).where("u <> v")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        least = both(current).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both(current).where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = cut(small.where("a <> b").distinct())
        if small.count() == current.count() and small.exceptAll(current).isEmpty():
            break
        current = small
    else:
        raise RuntimeError("components did not settle")
    root = current.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("component", "node").alias("component"))


def group_edges(groups: DataFrame) -> DataFrame:
    """(a, b) of arrays ``members``: each member beside the least of its group."""
    first = F.array_min("members")
    return groups.select(F.explode("members").alias("a"), first.alias("b"))


def merged_drops(groups: DataFrame, known: DataFrame, exact: DataFrame) -> DataFrame:
    """number: what overlapping groups of duplicates drop, keeping the least; only known numbers, without the exact drops."""
    found = components(group_edges(groups)).where("node <> component").select(F.col("node").alias("number"))
    return found.join(known, "number", "left_semi").join(exact, "number", "left_anti")
