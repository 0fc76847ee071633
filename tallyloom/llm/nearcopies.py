"""Near-duplicate records with small edits: all pairs of items at least THRESHOLD alike, exactly.

An item's set holds its neighbouring word pairs. Items share a bucket when they share one of their rare
pairs (prefix filter: two sets this alike must share a pair among the first of each, in any order that holds
for all sets, so no link is lost). The order is by how often a pair occurs, counted in a table of COUNTERS
counters, whatever the number of pairs; pairs that share a counter are told apart by their hashes.
Inside a bucket sets are bitmaps of BITS bits, ordered by population count and compared tile by tile with
numpy: exclusive-or and bit counts. A pair survives when its differing bits do not exceed the radius that
the threshold allows for its sizes; tile pairs whose population counts differ beyond the radius are
skipped. Survivors are verified on the sets themselves.

A bucket larger than BLOCK is split into blocks and every pair of blocks becomes its own group, so no task
holds an unbounded bucket and no row is dropped. Equal items (same copies key and same set) take part
once, by their smallest id; members are joined back to the pairs at the end.

Defined results: items without a word have no pairs; null stems and choices add nothing; pairs of copies
in the sense of ``copies`` are left out; each pair comes once, smaller id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.copies import canonical
from tallyloom.llm.copies import members as copies_members
from tallyloom.session import cut

THRESHOLD = 0.6
BITS = 256
TILE = 1024
BLOCK = 8192
COUNTERS = 1 << 20
SMALL = 64


def pair_set(fields: Column) -> Column:
    """64-bit hashes of the neighbouring word pairs of each field; the word itself for a one-word field."""
    words = F.transform(F.filter(fields, lambda f: f.isNotNull()), lambda f: F.regexp_extract_all(F.lower(f), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    pairs = F.transform(
        words,
        lambda w: F.when(F.size(w) <= 1, F.transform(w, lambda x: F.xxhash64(x))).otherwise(
            F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(pairs)))


def prepared(items: DataFrame, key: str = "item_id", stem: str = "stem", choices: str = "choices") -> DataFrame:
    """id, digest of the copies key, sorted set of pair hashes."""
    fields = F.concat(F.array(F.col(stem)), F.coalesce(F.map_values(F.col(choices)), F.array().cast("array<string>")))
    return items.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), canonical(F.col(stem), F.col(choices)).alias("digest"), pair_set(fields).alias("pairs")
    ).where(F.size("pairs") > 0)


def _bitmaps(rows: np.ndarray, tokens: np.ndarray, n: int) -> list[bytes]:
    """BITS bits for each of n sets given as (row, hash): bit h mod BITS is set."""
    bits = np.zeros((n, BITS), dtype=np.uint8)
    bits[rows, tokens & (BITS - 1)] = 1
    return [x.tobytes() for x in np.packbits(bits, axis=1)]


class Entries:
    """The bucket entries of sets: prefixes in the order of the counters, each with the set's size and bitmap."""

    def __init__(self, counters: np.ndarray, threshold: float):
        self.counters, self.threshold = counters, threshold

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = self.threshold
        for batch in batches:
            if not len(batch):
                continue
            size = batch["pairs"].map(len).to_numpy()
            rows, tokens = np.repeat(np.arange(len(batch)), size), np.concatenate(batch["pairs"].to_numpy()).astype(np.int64)
            bits = pd.Series(_bitmaps(rows, tokens, len(batch)), dtype=object)
            often = self.counters[tokens & (COUNTERS - 1)]
            order = np.lexsort((tokens, often, rows))
            at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            # A set's probe prefix serves partners of any size, its index prefix those at least as large.
            probe = size - np.ceil(t * size - 1e-9).astype(int) + 1
            index = size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(int) + 1
            # The least possible count of a pair is that of its counter: where that is one, no other set has the pair.
            kept = (at < probe[rows]) & (often[order] > 1)
            row, token, blocks = rows[kept], tokens[order][kept], -(-often[order][kept] // BLOCK)
            first = at[kept] < index[row]
            part = (batch["id"].to_numpy()[row].astype(np.int64) * 0x9E3779B1 >> 7) % blocks
            many = np.repeat(np.arange(len(row)), blocks)
            other = np.arange(len(many)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            i, j = np.minimum(part[many], other), np.maximum(part[many], other)
            yield pd.DataFrame({
                "id": batch["id"].to_numpy()[row[many]], "token": token[many], "first": first[many], "part": part[many], "i": i, "j": j,
                "size": size[row[many]], "bits": bits.to_numpy()[row[many]],
            })


class Tiles:
    """Compares the members of buckets; rows arrive sorted by bucket."""

    def __init__(self, threshold: float):
        # Sets of sizes a and b that are t alike differ in at most (1 - t) / (1 + t) * (a + b) members, so in no more bits.
        self.share = (1 - threshold) / (1 + threshold)

    def near(self, rows: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(rows["bits"][p] ^ rows["bits"][q]).sum(axis=1)
        keep = differ <= self.share * (rows["size"][p] + rows["size"][q]) + 1e-9
        return self.wanted(rows, p, q) & keep

    @staticmethod
    def wanted(rows: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """One of the two has the bucket in its index prefix; two blocks' group leaves the pairs within one block to that block's own."""
        return (rows["first"][p] | rows["first"][q]) & ((rows["i"][p] == rows["j"][p]) | (rows["part"][p] != rows["part"][q]))

    def small(self, rows: dict[str, np.ndarray], starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The near pairs of all buckets of one small size at once."""
        x, y = np.triu_indices(size, 1)
        p, q = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
        keep = self.near(rows, p, q)
        return p[keep], q[keep]

    def large(self, rows: dict[str, np.ndarray], start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One bucket in tiles, ordered by population count; tile pairs beyond the radius are skipped."""
        counts = np.bitwise_count(rows["bits"][start:stop]).sum(axis=1).astype(np.int32)
        order = start + np.argsort(counts, kind="stable")
        counts = np.sort(counts)
        tiles = [slice(k, min(k + TILE, len(order))) for k in range(0, len(order), TILE)]
        for x, a in enumerate(tiles):
            for b in tiles[x:]:
                pa, pb = order[a], order[b]
                radius = self.share * (float(rows["size"][pa].max()) + float(rows["size"][pb].max()))
                if counts[b].min() - counts[a].max() > radius:
                    continue
                differ = np.zeros((len(pa), len(pb)), dtype=np.uint16)
                for w in range(rows["bits"].shape[1]):
                    differ += np.bitwise_count(rows["bits"][pa, None, w] ^ rows["bits"][None, pb, w])
                close = differ <= self.share * (rows["size"][pa, None] + rows["size"][None, pb]) + 1e-9
                if a == b:
                    close = np.triu(close, 1)
                p, q = np.nonzero(close)
                p, q = pa[p], pb[q]
                keep = self.wanted(rows, p, q)
                yield p[keep], q[keep]

    def pairs(self, frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        rows = {c: frame[c].to_numpy() for c in ("id", "size", "first", "part", "i", "j")}
        rows["bits"] = np.frombuffer(b"".join(frame["bits"]), dtype=np.uint64).reshape(len(frame), -1)
        sizes, found = np.diff(bounds), []
        for size in np.unique(sizes):
            starts = bounds[:-1][sizes == size]
            if 2 <= size <= SMALL:
                step = max(1, 2_000_000 // (size * size))
                found += [self.small(rows, starts[k : k + step], int(size)) for k in range(0, len(starts), step)]
            elif size > SMALL:
                found += [x for s in starts for x in self.large(rows, s, s + size)]
        p = rows["id"][np.concatenate([x for x, _ in found])] if found else rows["id"][:0]
        q = rows["id"][np.concatenate([y for _, y in found])] if found else rows["id"][:0]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the bucket that may go on in the next batch, of at most 2 * BLOCK rows
        for batch in batches:
            if not len(batch):
                continue
            frame = pd.concat([*kept, batch], ignore_index=True) if kept else batch
            key = frame[["token", "i", "j"]].to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(changes):
                kept = [frame]
                continue
            kept = [frame.iloc[changes[-1] :]]
            yield self.pairs(frame.iloc[: changes[-1]], np.concatenate([[0], changes]))
        if kept:
            frame = pd.concat(kept, ignore_index=True)
            yield self.pairs(frame, np.array([0, len(frame)]))


def counters(sets: DataFrame) -> np.ndarray:
    """How many pairs of all sets fall to each of COUNTERS counters: an array of fixed size, whatever the number of sets."""
    held = sets.select(F.explode("pairs").alias("token")).groupBy(F.col("token").bitwiseAND(F.lit(COUNTERS - 1)).alias("counter")).agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[held["counter"].to_numpy(dtype=np.int64)] = held["n"].to_numpy(dtype=np.int64)
    return out


def class_pairs(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b, differ) of class representatives at least ``threshold`` alike, and the membership (id, class, rep, n)."""
    # A class is told by the copies key and a hash of the set, 64 bits beside 256.
    every = cut(prepared(items).withColumn("class", F.concat("digest", F.unhex(F.hex(F.xxhash64("pairs"))))))
    members = cut(copies_members(every.select("id", F.col("class").alias("digest")).distinct()).select("id", F.col("digest").alias("class"), F.col("kept_id").alias("rep"), F.col("n_copies").alias("n")))
    # A repeated row stays here; what it finds is found once more, and falls together below.
    reps = every.join(members.where("id = rep").select("id", "class"), ["id", "class"], "left_semi").select(F.col("id").alias("rep"), "digest", "pairs")
    entries = reps.select(F.col("rep").alias("id"), "pairs").mapInPandas(
        Entries(counters(reps), threshold).__call__, f"id {_type(items)}, token bigint, first boolean, part bigint, i bigint, j bigint, size bigint, bits binary"
    )
    candidates = (
        entries.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        .mapInPandas(Tiles(threshold).__call__, f"a {_type(items)}, b {_type(items)}").where("a <> b").distinct()
    )
    left = reps.select(F.col("rep").alias("a"), F.col("digest").alias("da"), F.col("pairs").alias("pa"))
    right = reps.select(F.col("rep").alias("b"), F.col("digest").alias("db"), F.col("pairs").alias("pb"))
    both = F.size(F.array_intersect("pa", "pb"))
    alike = candidates.join(left, "a").join(right, "b").where(both >= F.lit(threshold) * (F.size("pa") + F.size("pb") - both) - 1e-9)
    return alike.select("a", "b", (F.col("da") != F.col("db")).alias("differ")), members


def _type(items: DataFrame) -> str:
    return items.schema["item_id"].dataType.simpleString()


def near_pairs(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id_a, item_id_b: every pair of items of different copy groups that is at least ``threshold`` alike."""
    pairs, members = class_pairs(items, threshold)
    pairs = cut(pairs.where("differ").select("a", "b"))
    several = members.select("rep", "id")
    # TESTDATA.md defines the result as pairs of items, so here the members of two classes do meet.
    return (
        pairs.join(several.withColumnsRenamed({"rep": "a", "id": "x"}), "a").join(several.withColumnsRenamed({"rep": "b", "id": "y"}), "b")
        .where("x <> y").select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b")).distinct()
    )


def near_groups(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, class_id, linked_class: every item with its class of equal items, and a row for each near class; null for a class without one.

    The rows with item_id = class_id are the pairs of representatives, all rows the membership: groups can be
    built from them, and no class is multiplied by another.
    """
    pairs, members = class_pairs(items, threshold)
    pairs = cut(pairs.select("a", "b").distinct())
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("linked")).union(pairs.select("b", "a"))
    links = members.where("id = rep").select("id", "rep").join(ends, "rep", "left").select(F.col("id").alias("item_id"), F.col("rep").alias("class_id"), F.col("linked").alias("linked_class"))
    others = members.where("id <> rep").select(F.col("id").alias("item_id"), F.col("rep").alias("class_id"), F.lit(None).cast(_type(items)).alias("linked_class"))
    return links.unionByName(others)
