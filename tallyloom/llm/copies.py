"""Duplicates hidden by formatting differences: equal after lower-casing and dropping all but letters and digits.

Each item is read once and becomes its id and a digest of its canonical form. Keys are counted with partial
counts, which find the hot ones (more than HOT members) exactly. Members of hot keys are salted and grouped
in two levels (key and salt, then key), so a key that holds a third of all rows costs no task more than its
share; all other keys take one shuffle, with at most HOT rows of a key in a task.

Hot keys are few by construction (at most rows / HOT); they are joined by broadcast when they fit
BROADCAST_KEYS, else with salts.

Defined results: a null stem equals a stem without letters or digits; null choices are left out, a null
map has none; the representative is the smallest id; repeated rows with one id are one item; items without
an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

HOT, SALTS, BROADCAST_KEYS = 10_000, 64, 50_000


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]++", "")


def canonical(stem: Column, choices: Column) -> Column:
    """A 256-bit digest of the squashed stem and the sorted squashed choices."""
    values = F.array_sort(F.transform(F.filter(F.map_values(choices), lambda v: v.isNotNull()), squash))
    # Nothing squashed holds a separator, so the joined text is unambiguous.
    return F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce(squash(stem), F.lit("")), F.coalesce(values, F.array().cast("array<string>"))), 256))


def keyed(items: DataFrame, key: str = "item_id", stem: str = "stem", choices: str = "choices") -> DataFrame:
    return items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), canonical(F.col(stem), F.col(choices)).alias("digest"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")


def members(keys: DataFrame) -> DataFrame:
    """id, digest, kept_id, n_copies of every row of ``keys`` (id, digest; written, each once), singletons included."""
    hot = cut(keys.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("digest"))
    few = hot.count() <= BROADCAST_KEYS
    small = F.broadcast if few else lambda frame: frame
    group = Window.partitionBy("digest")
    cold = keys.join(small(hot), "digest", "left_anti").select("id", "digest", F.min("id").over(group).alias("kept_id"), F.count("*").over(group).alias("n_copies"))
    salted = keys.join(small(hot), "digest", "left_semi").withColumn("salt", _salt())
    first = salted.groupBy("digest", "salt").agg(F.min("id").alias("kept_id"), F.count("*").alias("n"))
    grouped = first.groupBy("digest").agg(F.min("kept_id").alias("kept_id"), F.sum("n").alias("n_copies"))
    if few:
        warm = salted.join(F.broadcast(grouped), "digest")
    else:
        warm = salted.join(grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"])
    return cold.unionByName(warm.select("id", "digest", "kept_id", "n_copies"))


def copies(items: DataFrame) -> DataFrame:
    """kept_id, copy_id: one row for each member but the representative."""
    return members(cut(keyed(items).distinct())).where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def collapsed(items: DataFrame) -> DataFrame:
    """The representatives with all their columns and n_copies."""
    kept = members(cut(keyed(items).distinct())).where("id = kept_id").select(F.col("id").alias("item_id"), "n_copies")
    clashing = [c for c in ("n_copies",) if c in items.columns]
    return items.drop(*clashing).dropDuplicates(["item_id"]).join(kept.groupBy("item_id").agg(F.max("n_copies").alias("n_copies")), "item_id")
