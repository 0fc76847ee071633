"""Planned operators of an evaluation pipeline: splits, fuzzy duplicates, votes, chunks, retrieval, contamination."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import squash


def majority(votes: DataFrame, keys: list[str], letter: str) -> DataFrame:
    """keys, letter, votes, voters: the most frequent letter, the least of equals."""
    counted = votes.groupBy(*keys, letter).agg(F.count("*").alias("votes"))
    # The order of letters is turned around so that the least letter wins among equals.
    best = F.max_by(F.struct(letter, "votes"), F.struct("votes", -F.ascii(letter)))
    return counted.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("voters")).select(*keys, f"b.{letter}", "b.votes", "voters")


def run_verdict(accuracy: DataFrame, latency: DataFrame, passing: float = 70.0) -> DataFrame:
    """Each run with its mean latency and whether it passes."""
    mean = latency.groupBy("run").agg(F.bround(F.avg("latency_s"), 3).alias("mean_latency_s"))
    return accuracy.join(mean, "run", "left").withColumn("passed", F.col("pct") >= passing)


def chunks(words: Column, size: int = 512, overlap: int = 64) -> Column:
    """Arrays of (chunk_no, words) of ``size`` words that share ``overlap`` with the one before."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), F.slice(words, i * step + 1, F.lit(size)).alias("words")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(queries: DataFrame, base: DataFrame, k: int, most_queries: int = 2_000, block: int = 256) -> DataFrame:
    """query_id, vec_id, score, rank: exact k nearest by cosine; the queries go in blocks against all rows.

    At most ``most_queries`` go in one pass over the rows; each task keeps its own best k of a block, by rounded score
    and then the smallest vec_id, before anything is shuffled.
    """
    rows = queries.select("vec_id", "embedding").toLocalIterator()
    found = _best(list(islice(rows, most_queries)), base, k, block)
    while more := list(islice(rows, most_queries)):
        found = found.unionAll(_best(more, base, k, block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(rows: list[Row], base: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each batch for each of the queries ``rows``."""
    import numpy as np
    import pandas as pd

    ids = np.array([r.vec_id for r in rows])
    q = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def scan(batches):
        for batch in batches:
            v = np.array(batch["embedding"].tolist(), dtype=np.float64)
            if not len(v) or not len(q):
                continue
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            vec, out = batch["vec_id"].to_numpy(), []
            by_id = np.argsort(vec, kind="stable")
            v, vec = v[by_id], vec[by_id]
            for start in range(0, len(q), block):
                scores = q[start : start + block] @ v.T
                scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores) / 1e6 + 0.0
                scores[ids[start : start + block, None] == vec[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                for i, row in enumerate(best):
                    out += [(ids[start + i], vec[j], scores[i, j]) for j in row if scores[i, j] > -np.inf]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    kind = base.schema["vec_id"].dataType.simpleString()
    return base.select("vec_id", "embedding").mapInPandas(scan, f"query_id {kind}, vec_id {kind}, score double")


def letter_distribution(letters: DataFrame, by: list[str]) -> DataFrame:
    """by, letter, n, share within ``by``."""
    counted = letters.groupBy(*by, "letter").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 5))


def richer(items: DataFrame, key: Column, fields: list[str], order: str) -> DataFrame:
    """Of items with equal keys the one with the most non-blank fields, then the longest text, then the first."""
    filled = sum((F.when(F.coalesce(F.trim(f), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    length = sum((F.length(F.coalesce(f, F.lit(""))) for f in fields), F.lit(0))
    ranked = items.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*items.columns), F.struct(filled, length, -F.col(order))).alias("x"))
    return ranked.where("_key <> ''").select("x.*").unionByName(items.where(F.coalesce(key, F.lit("")) == ""))


def contaminated(texts: DataFrame, held_out: DataFrame, key: str, text: str, n: int = 8, most_known: int = 2_000_000) -> DataFrame:
    """key, n_shared: rows that share runs of n words with any held-out text, and how many different ones.

    Runs meet as 64-bit hashes. Where the held-out runs are few enough (checked) they are broadcast, and a hit is
    verified word by word where the text is; beyond that the hits alone are shuffled, told apart by 128 bits.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    starts = f"transform(filter(sequence(0, size(w) - {n}), i -> size(w) >= {n}), i -> i)"
    known = held_out.select(words(F.col("question")).alias("w")).where(F.size("w") >= n)
    known = known.select(F.expr(f"explode(transform({starts}, i -> slice(w, i + 1, {n})))").alias("g")).select(F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("g")).distinct()
    seen = texts.select(key, words(F.col(text)).alias("w")).where(F.size("w") >= n)
    if known.limit(most_known + 1).count() <= most_known:
        at = seen.select(key, "w", F.expr(f"posexplode_outer(transform({starts}, i -> xxhash64(slice(w, i + 1, {n}))))").alias("i", "h"))
        hits = at.join(F.broadcast(known), "h").where(F.expr(f"array_join(slice(w, i + 1, {n}), ' ') = g")).select(key, "g")
        return hits.distinct().groupBy(key).agg(F.count("*").alias("n_shared"))
    wide = lambda g: F.struct(F.xxhash64(g), F.xxhash64(F.lit(1), g))
    at = seen.select(key, F.explode(F.expr(f"array_distinct(transform({starts}, i -> array_join(slice(w, i + 1, {n}), ' ')))")).alias("g")).select(key, wide(F.col("g")).alias("g"))
    return at.join(known.select(wide(F.col("g")).alias("g")), "g", "left_semi").groupBy(key).agg(F.count("*").alias("n_shared"))
