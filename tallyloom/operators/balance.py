"""Balancing buckets: deficits, top N a bucket, keep-lists, samples, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import valid_letter
from tallyloom.operators.dedupe import numbered
from tallyloom.schema import bucket_dimension


def histogram(assigned: DataFrame) -> DataFrame:
    """bucket, bucket_name, n of all eight buckets, zeros included."""
    counted = assigned.groupBy("bucket").agg(F.count("*").alias("n"))
    return bucket_dimension(assigned.sparkSession).join(counted, "bucket", "left").select("bucket", "bucket_name", F.coalesce("n", F.lit(0)).alias("n"))


def deficit_plan(assigned: DataFrame, target: int) -> DataFrame:
    """bucket, have, keep, generate for a target size of each bucket, and in total what all eight lack."""
    have = F.col("n")
    plan = histogram(assigned).select(
        "bucket", have.alias("have"), F.least(have, F.lit(target)).cast("bigint").alias("keep"), F.greatest(F.lit(0), F.lit(target) - have).cast("bigint").alias("generate"),
    )
    return plan.withColumn("total", F.sum("generate").over(Window.partitionBy()))  # eight rows


def first_of_each(items: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each group; Spark turns the rank filter into a group limit before the shuffle."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def seeded(seed: int, id_: Column) -> Column:
    """An order by hash that is the same at every run, every partitioning and in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), id_.cast("string")))


def sample_of_each(items: DataFrame, by: list[str], id_: str, n: int, seed: int = 42) -> DataFrame:
    return first_of_each(items, by, [seeded(seed, F.col(id_)), F.col(id_)], n)


def keep_list(keep: Column, most: int, n: int) -> Column:
    """1-based indices: repeats and those above ``most`` left out, filled up with the least missing, cut to n, sorted."""
    valid = F.filter(F.array_distinct(keep), lambda x: x.between(1, most))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(most)), valid)
    return F.array_sort(F.slice(F.concat(valid, missing), 1, n))


def laid_out(ordinal: Column, per_bucket: int) -> Column:
    return (F.floor((ordinal - 1) / per_bucket) + 1).cast("int")


def batches(items: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    """by, batch, members: consecutive slices of ``size`` within ``by``."""
    slices = numbered(items.select(*by, order), order, by).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))
    return slices.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(order)).alias("members"))


def split_band(id_: Column, test: int = 10, validation: int = 20) -> Column:
    """train, validation or test by a hash of the id, in percent."""
    band = F.conv(F.left(F.md5(id_.cast("string")), F.lit(7)), 16, 10).cast("int") % 100
    return F.when(band < test, "test").when(band < test + validation, "validation").otherwise("train")


def well_formed(stem: Column, choices: Column, least_stem: int = 25, least_option: int = 8) -> Column:
    """A long enough stem and four distinct, long enough options."""
    values = F.map_values(choices)
    return (
        (F.length(F.coalesce(stem, F.lit(""))) >= least_stem) & (F.size(values) == 4)
        & F.forall(values, lambda v: F.length(v) >= least_option) & (F.size(F.array_distinct(values)) == 4)
    )


#: names of the gates, with the least length of a stem and of an option, and whether options must differ
GATES = {"generated": (25, 8, True), "cards": (10, 2, True), "repaired": (1, 3, False), "pages": (1, 1, True)}


def passes(gate: str, stem: Column, choices: Column, letter: Column | None = None) -> Column:
    """Whether an item passes one of GATES; where a letter is given it must be one of A to D and name an option."""
    least_stem, least_option, distinct = GATES[gate]
    values = F.transform(F.filter(F.map_values(choices), lambda v: v.isNotNull()), lambda v: F.trim(v))
    good = (F.length(F.trim(F.coalesce(stem, F.lit("")))) >= least_stem) & (F.size(values) == 4) & F.forall(values, lambda v: F.length(v) >= least_option)
    if distinct:
        good = good & (F.size(F.array_distinct(values)) == 4)
    if letter is not None:
        good = good & F.coalesce(valid_letter(letter).isNotNull() & F.array_contains(F.map_keys(choices), valid_letter(letter)), F.lit(False))
    return F.coalesce(good, F.lit(False))


def as_item(stem: Column, choices: Column, answer: Column, number: Column) -> Column:
    """A flat item (stem, A to D, answer, notes) with a note of where it comes from."""
    letters = [F.trim(F.coalesce(F.try_element_at(choices, F.lit(x)), F.lit(""))).alias(x) for x in "ABCD"]
    return F.struct(stem.alias("stem"), *letters, answer.alias("answer"), F.concat(F.lit("kept_from_q"), number.cast("string")).alias("notes"))


def review_counts(items: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """parsed, removed, kept: items, those whose key is among the dropped, and the rest."""
    hit = items.select(key).join(dropped.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("parsed"), F.count("hit").alias("removed"), (F.count("*") - F.count("hit")).alias("kept"))


def answerable(choices: Column) -> Column:
    """Two or more non-empty choices."""
    return F.size(F.filter(F.map_values(choices), lambda v: F.trim(v) != "")) >= 2
