"""Filling fixed-capacity containers with texts measured in tokens, splitting only what exceeds the capacity.

Linear grouping scheme, on the histogram of sizes (at most ``capacity`` numbers, whatever the number of
texts): sizes above SMALL of the capacity are large; the large items, in order of size, are cut into GROUPS
groups of equal cardinality and rounded up to the largest of each. Configurations of these few sizes are
optimised one after the other: the largest size left, completed by the bounded knapsack that fills the
container best, used as often as the counts allow. Actual texts take the places of the rounded ones, which
leaves their exact room; small items go by best fit, in decreasing size, into the tightest container.

The plan says for each size which ranks go to which range of containers, so it has a few rows a size; texts
find their place by their rank within their size. Ranks are counted in two levels (salt, then rank within
the salt), so a size that a third of all texts share does not meet in one task.

Defined results: a text larger than the capacity gives full containers of its own and one rest, packed as
an item; null and empty texts take no room and get no container; equal texts are packed one by one; rows
with one id twice are two texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SMALL, GROUPS, SALTS = 0.125, 64, 64
#: packs beside every text, and steps of all plans, that may be broadcast; a plan has a few steps for each size, and no more sizes than its capacity has tokens
MOST_PACKS, MOST_STEPS = 1_000, 2_000_000


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, size in tokens of the byte-level BPE whose ranks lie at ``tokenizer`` on every executor."""
    pattern = PATTERN

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "size": [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(measure, f"doc_id {kind}, size bigint")


class Bins:
    """Ranges of containers with the same room left, and the ranks of each size that were put in."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first container, how many)
        self.plan: list[tuple[int, int, int, int, int]] = []  # size, first rank, end rank, first container, items a container
        self.rank: dict[int, int] = {}

    def put(self, size: int, first: int, count: int, each: int) -> None:
        start = self.rank.get(size, 0)
        self.rank[size] = start + count * each
        self.plan.append((size, start, start + count * each, first, each))

    def keep(self, room: int, first: int, count: int) -> None:
        if count and room > 0:
            self.rooms.setdefault(room, []).append((first, count))

    def open(self, count: int) -> int:
        self.used += count
        return self.used - count

    def fill(self, room: int, first: int, count: int, size: int, n: int) -> int:
        """Put up to n items of the size into the range, as many as fit in a container before the next; gives what is left."""
        each = room // size
        full = min(count, n // each)
        if full:
            self.put(size, first, full, each)
            self.keep(room - each * size, first, full)
            n -= full * each
        if n and full < count:
            self.put(size, first + full, 1, n)
            self.keep(room - n * size, first + full, 1)
            full, n = full + 1, 0
        self.keep(room, first + full, count - full)
        return n

    def best_fit(self, size: int, n: int) -> None:
        for room in sorted(r for r in self.rooms if r >= size):
            for first, count in self.rooms.pop(room):
                if n:
                    n = self.fill(room, first, count, size, n)
                else:
                    self.keep(room, first, count)
            if not n:
                return
        if n:
            each = self.capacity // size
            count = -(-n // each)
            self.fill(self.capacity, self.open(count), count, size, n)


def _groups(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """The items in decreasing size, cut into groups of equal cardinality: (size, count) runs of each."""
    total, out, at = int(counts.sum()), [], 0
    bounds = [round(total * (g + 1) / groups) for g in range(groups)]
    runs: list[tuple[int, int]] = []
    for size, count in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
        while count:
            take = min(count, bounds[len(out)] - at)
            if take:
                runs.append((size, take))
                at, count = at + take, count - take
            if at == bounds[len(out)]:
                if runs:
                    out.append(runs)
                    runs = []
                else:
                    bounds.pop(len(out))
    return out


def _best_configuration(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How many of each size fill the room best (bounded knapsack, value = size), larger sizes first."""
    reach: list[tuple[int, int] | None] = [None] * (room + 1)
    reach[0] = (-1, -1)
    points = [0]
    for g, size in enumerate(sizes):
        if not left[g] or size > room:
            continue
        fresh = []
        for start in points:
            at, k = start, 0
            while at + size <= room and k < left[g] and reach[at + size] is None:
                reach[at + size] = (g, at)
                at, k = at + size, k + 1
                fresh.append(at)
        points += fresh
        if reach[room] is not None:
            break
    best = max(i for i in range(room + 1) if reach[i] is not None)
    taken = [0] * len(sizes)
    while best:
        g, best = reach[best]
        taken[g] += 1
    return taken


def plan(capacity: int, histogram: dict[int, int], small: float = SMALL, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan rows (size, first rank, end rank, first container, items a container) and the number of containers."""
    bins = Bins(capacity)
    large = {s: n for s, n in histogram.items() if s > small * capacity}
    if large:
        runs = _groups(np.array(list(large)), np.array(list(large.values())), groups)
        rounded, left = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]
        queue = [list(r) for r in runs]
        while any(left):
            g = next(i for i, n in enumerate(left) if n)
            left[g] -= 1
            taken = _best_configuration(capacity - rounded[g], rounded, left)
            left[g] += 1
            taken[g] += 1
            times = min(left[i] // k for i, k in enumerate(taken) if k)
            first = bins.open(times)
            ranges = [(first, times, capacity)]
            for i, k in enumerate(taken):
                if not k:
                    continue
                left[i] -= k * times
                for _ in range(k):  # one place after the other takes the group's actual sizes in order
                    filled = []
                    for start, count, room in ranges:
                        while count:
                            size, n = queue[i][0]
                            take = min(n, count)
                            bins.put(size, start, take, 1)
                            filled.append((start, take, room - size))
                            start, count = start + take, count - take
                            queue[i][0] = (size, n - take)
                            if n == take:
                                queue[i].pop(0)
                    ranges = filled
            for start, count, room in ranges:
                bins.keep(room, start, count)
    for size in sorted((s for s in histogram if s <= small * capacity), reverse=True):
        bins.best_fit(size, histogram[size])
    return bins.plan, bins.used


def few_packs(packs: DataFrame) -> list[tuple]:
    """(pack_id, capacity) of the packs with room, at most MOST_PACKS, checked."""
    rows = packs.select("pack_id", "capacity").where("capacity > 0").distinct().orderBy("capacity", "pack_id").limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    return [(r.pack_id, r.capacity) for r in rows]


def beside(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """The sizes beside every pack: an array of the checked packs, exploded, which is no join."""
    kinds = [packs.schema[c].dataType for c in ("pack_id", "capacity")]
    made = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, ("pack_id", "capacity"), strict=True)]) for row in few_packs(packs)]
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField(c, k) for c, k in zip(("pack_id", "capacity"), kinds, strict=True)])))
    return sizes.withColumn("pack", F.explode(F.array(*made) if made else empty)).select("*", "pack.*").drop("pack")


def items(sizes: DataFrame) -> DataFrame:
    """pack_id, capacity, doc_id, part, tokens: the whole texts and the rests of split ones; full parts stay out."""
    return sizes.where("size > 0").select(
        "pack_id", "capacity", "doc_id", F.expr("case when size > capacity then size div capacity else 0 end").alias("part"),
        F.expr("case when size > capacity then size % capacity else size end").alias("tokens"),
    ).where("tokens > 0")


def packed(documents: DataFrame, packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_id, capacity, tokenizer, doc_id, part, tokens, container_id: where every part of every text goes."""
    spark = documents.sparkSession
    sizes = cut(sized(documents, tokenizer=tokenizer))
    every = beside(sizes, packs)
    # As many salts as keep a size that a third of all texts share at about a million ranks a task.
    salts = max(SALTS, sizes.count() // 3_000_000)
    todo = items(every).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = cut(todo.groupBy("pack_id", "capacity", "tokens", "salt").agg(F.count("*").alias("n")))
    # Bounded by the capacities: a pack has no more sizes than its capacity has tokens.
    rows = counts.groupBy("pack_id", "capacity", "tokens").agg(F.sum("n").alias("n")).collect()
    plans = []
    for pack, capacity in sorted({(r.pack_id, r.capacity) for r in rows}):
        steps, _ = plan(capacity, {r.tokens: r.n for r in rows if r.pack_id == pack})
        plans += [(pack, *(int(x) for x in s)) for s in steps]
    if len(plans) > MOST_STEPS:
        raise ValueError(f"plans of more than {MOST_STEPS} steps")
    kind = packs.schema["pack_id"].dataType.simpleString()
    steps = spark.createDataFrame(plans, f"pack_id {kind}, tokens bigint, lo bigint, hi bigint, first bigint, each bigint")
    before = Window.partitionBy("pack_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_id", "tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pack_id", "tokens", "salt").orderBy("doc_id")
    ranked = (
        todo.withColumn("row", F.row_number().over(within)).join(offsets, ["pack_id", "tokens", "salt"])
        .select("pack_id", "capacity", "doc_id", "part", "tokens", (F.col("offset") + F.col("row") - 1).alias("rank"))
    )
    name = F.lit(tokenizer.rsplit("/", 1)[-1]).alias("tokenizer")
    placed = (
        ranked.join(F.broadcast(steps), ["pack_id", "tokens"]).where("rank >= lo and rank < hi")
        .select("pack_id", "capacity", name, "doc_id", "part", "tokens", F.expr("concat('c', first + (rank - lo) div each)").alias("container_id"))
    )
    same_id = Window.partitionBy("pack_id", "doc_id").orderBy("size")
    own = (
        every.where("size > capacity").withColumn("again", F.row_number().over(same_id))
        .select("pack_id", "capacity", name, "doc_id", "again", F.explode(F.expr("sequence(0L, size div capacity - 1)")).alias("part"), F.col("capacity").cast("bigint").alias("tokens"))
        .withColumn("container_id", F.concat(F.lit("d"), "doc_id", F.lit("-"), "part", F.when(F.col("again") > 1, F.concat(F.lit("#"), "again")).otherwise("")))
        .drop("again")
    )
    empty = every.where("size = 0").select(
        "pack_id", "capacity", name, "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container_id")
    )
    return placed.unionByName(own).unionByName(empty)


def report(assigned: DataFrame) -> DataFrame:
    """pack_id, capacity, n_containers, least_containers, n_tokens, n_split_texts, overfull, share_filled."""
    boxes = assigned.where("container_id is not null").groupBy("pack_id", "capacity", "container_id").agg(F.sum("tokens").alias("t"))
    per_pack = boxes.groupBy("pack_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.count(F.when(F.col("t") > F.col("capacity"), 1)).alias("overfull"))
    split = assigned.where("part > 0").groupBy("pack_id").agg(F.count_distinct("doc_id").alias("n_split_texts"))
    return per_pack.join(split, "pack_id", "left").select(
        "pack_id", "capacity", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), "n_tokens",
        F.coalesce("n_split_texts", F.lit(0)).alias("n_split_texts"), "overfull", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("share_filled"),
    )
