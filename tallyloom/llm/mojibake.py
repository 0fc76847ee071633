"""Garbled text from wrong character encoding: find the records and restore the original text.

Runs of non-ASCII characters stand between ASCII characters, which a wrong decoding leaves as they are. Records
that are equal once stripped of non-ASCII characters are twins: their runs are aligned by position, and the
transformations (pairs of encodings, applied once or twice) are inferred that turn the one run into the other.
Most garbled records have no such twin in a corpus, so windows of ASCII characters around a run stand for
records as well: different runs of equal windows are aligned in the same way, there with the common run as the
clean one. Either way partners are met by an equi-join on the place and the undone run, never as all pairs.

A transformation counts when enough different aligned runs support it. Learned mappings are then applied to
all records: a run is garbled when undoing a learned transformation gives the run of a twin record in its
position, a run that is far more frequent in that place, or (for transformations that turn one character into
several, which correct text does not produce by chance) a usual run of the corpus. Replacement characters are
lossy: such records are reported but not restored.

Defined results: null and empty texts and texts in ASCII are not garbled; equal texts get equal results; copies of a text do not speak for its runs,
only where distinct texts leave it open do all rows decide;
accents and marks that are frequent in their place are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

#: characters of a place: in judging, and in learning
NEAR, WIDE = 2, 6
MIN_PAIRS = 3
TIMES, MIN_CLEAN = 5, 3
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1250", "iso8859-2", "iso8859-5", "cp1253", "cp1254", "cp852")
LOSSY = "�"


def _table(codec: str) -> list[str]:
    """What a lenient decoder makes of each byte: undefined bytes become the control character of that number."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


class Chain:
    """The text was encoded in ``true`` and decoded as ``taken``, ``times`` times."""

    def __init__(self, true: str, taken: str, times: int = 1):
        self.name, self.true, self.taken, self.times = f"{true}>{taken}" + f"x{times}" * (times > 1), true, taken, times
        self.byte_of = {c: b for b, c in reversed(list(enumerate(_table(taken))))}
        self.of_byte = None if true == "utf-8" else _table(true)

    def undo(self, text: str) -> str | None:
        for _ in range(self.times):
            try:
                raw = bytes(self.byte_of[c] for c in text)
                text = raw.decode("utf-8") if self.of_byte is None else "".join(self.of_byte[b] for b in raw)
            except (KeyError, UnicodeDecodeError):
                return None
        return text

    @property
    def grows(self) -> bool:
        return self.true == "utf-8"


def chains() -> list[Chain]:
    single = [Chain(a, b) for a, b in product(SINGLE, SINGLE) if a != b]
    return [Chain("utf-8", b, n) for n in (1, 2) for b in SINGLE] + single


def _context(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "9"), r"\s", " ")


def _pieces(documents: DataFrame, key: str, text: str) -> DataFrame:
    """k, v, r, s of the texts with non-ASCII characters: their runs of these and what stands before, between and after."""
    body = documents.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("v", F.xxhash64("t"))
    return body.select("k", "v", F.regexp_extract_all("t", F.lit(r"[^\x00-\x7F]+"), F.lit(0)).alias("r"), F.split("t", r"[^\x00-\x7F]+").alias("s"))


def _skeleton() -> Column:
    """A hash of what is left without the runs, and of how many there are."""
    return F.xxhash64(F.array_join("s", ""), F.size("r"))


def twin_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, v, sk, at, run: the runs in each position of the records that have a twin, that is, an equal skeleton and another text."""
    seen = cut(_pieces(documents, key, text).select("k", "v", _skeleton().alias("sk")))
    # Least and greatest version of a skeleton are counted before the shuffle, so a skeleton that many records share is no hot task.
    several = seen.groupBy("sk").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("sk")
    ids = seen.join(several, "sk", "left_semi").select(F.col("k").alias(key)).distinct()
    # Only records with a twin are read once more.
    body = _pieces(documents.join(ids, key, "left_semi"), key, text).withColumn("sk", _skeleton())
    return cut(body.select("k", "v", "sk", F.posexplode("r").alias("at", "run")).distinct())


def runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, version (a hash of the text), position, run of non-ASCII characters, the ASCII characters before and after it; equal rows once."""
    parts = _pieces(documents, key, text)
    near = F.expr(f"transform(r, (x, i) -> struct(i as at, x as run, right(concat(' ', get(s, i)), {WIDE}) as l, left(concat(get(s, i + 1), ' '), {WIDE}) as r))")
    return parts.select("k", "v", F.explode(near).alias("x")).select("k", "v", "x.at", "x.run", _context(F.col("x.l")).alias("l"), _context(F.col("x.r")).alias("r"))


def _undone(names: set[str] | None = None):
    """Batches of runs to (run, clean, chain, grows) for every chain (of the names) that can be undone."""

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [c for c in chains() if names is None or c.name in names]
        for batch in batches:
            hits = [(x, y, c.name, c.grows) for x in batch["run"] for c in known if (y := c.undo(x)) is not None and y != x]
            yield pd.DataFrame(hits, columns=["run", "clean", "chain", "grows"])

    return undo


UNDONE = "run string, clean string, chain string, grows boolean"


def learned(counts: DataFrame, twins: DataFrame) -> tuple[list[str], DataFrame]:
    """Names of the transformations that aligned runs support (at most one for each pair of encodings reaches the driver), and (sk, at, run, clean) of twins that one of them explains."""
    present = counts.select("run").distinct()
    # What no run of the corpus is falls away before the places are joined, so that every run of a place can be a partner.
    pairs = cut(present.repartition("run").mapInPandas(_undone(), UNDONE).join(present.withColumnRenamed("run", "clean"), "clean", "left_semi"))
    partner = counts.select("l", "r", F.col("run").alias("clean"), F.col("n").alias("clean_n"), F.col("rows").alias("clean_rows"))
    grouped = pairs.groupBy("run", "clean").agg(F.collect_list("chain").alias("chains"))  # at most as many as there are chains
    windows = (
        counts.join(grouped, "run").join(partner, ["l", "r", "clean"])
        .where("clean_n > n or clean_n = n and clean_rows > rows").select("run", F.explode("chains").alias("chain"))
    )
    # Of two twins the one that a transformation from one character to several explains is the garbled one; other transformations work both ways.
    places = twins.select("sk", "at", "run").distinct()
    aligned = cut(places.join(pairs.where("grows"), "run").join(places.withColumnRenamed("run", "clean"), ["sk", "at", "clean"]).select("sk", "at", "run", "clean", "chain"))
    support = windows.unionByName(aligned.select("run", "chain")).groupBy("chain").agg(F.count_distinct("run").alias("n"))
    names = sorted(r.chain for r in support.where(F.col("n") >= MIN_PAIRS).collect())
    return names, aligned.where(F.col("chain").isin(names)).groupBy("sk", "at", "run").agg(F.min("clean").alias("clean"))


def garbled_runs(found: DataFrame, twins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(l, run, r, clean) of the runs that are garbled where they stand (near contexts; clean is null where the text was lost), and (sk, at, run, clean) of those that twins show."""
    # n counts copies of a text once, for they hold the same runs at the same positions; rows counts them all.
    each = found.groupBy("l", "run", "r", "v", "at").agg(F.count("*").alias("rows"))
    wide = each.groupBy("l", "run", "r").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    wide = cut(wide)
    names, shown = learned(wide, twins)
    near = cut(wide.groupBy(F.right("l", F.lit(NEAR)).alias("l"), "run", F.left("r", F.lit(NEAR)).alias("r")).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")))
    alone = near.groupBy("run").agg(F.sum("rows").alias("rows"))

    # A run is undone once, however many places it has.
    clean = near.where(~F.col("run").contains(LOSSY)).select("run").distinct().repartition("run").mapInPandas(_undone(set(names)), UNDONE)
    clean = clean.where(r"trim(clean) <> '' and clean rlike '[^\\x00-\\x7F]'").groupBy("run", "clean").agg(F.bool_or("grows").alias("grows"), F.bool_and("grows").alias("only"))
    clean = clean.select("run", "clean", F.explode(F.when(F.col("grows") & ~F.col("only"), F.array(F.lit(True), F.lit(False))).otherwise(F.array("grows"))).alias("grows"))
    tried = near.where(~F.col("run").contains(LOSSY)).join(clean, "run")
    often = lambda n: F.coalesce("here", F.lit(0)) >= F.greatest(F.lit(MIN_CLEAN), F.col(n) * TIMES)
    judged = (
        tried.join(near.select("l", F.col("run").alias("clean"), "r", F.col("n").alias("here_n"), F.col("rows").alias("here")), ["l", "clean", "r"], "left")
        .join(alone.select(F.col("run").alias("clean"), F.col("rows").alias("anywhere")), "clean", "left")
        .where(
            ((F.col("here_n") > F.col("n")) & often("n")) | ((F.col("here_n") >= F.col("n")) & often("rows"))
            | (F.col("grows") & ((F.coalesce("anywhere", F.lit(0)) >= MIN_CLEAN) | (F.length("run") >= F.length("clean") + 2)))
        )
        .groupBy("l", "run", "r").agg(F.max_by("clean", F.struct(F.coalesce("here", F.lit(0)), F.col("grows"), F.coalesce("anywhere", F.lit(0)), "clean")).alias("clean"))
    )
    lost = near.where(F.col("run").contains(LOSSY)).select("l", "run", "r", F.lit(None).cast("string").alias("clean"))
    return judged.unionByName(lost), shown


def _marked(documents: DataFrame) -> DataFrame:
    """k, v, at, run, clean of each garbled run, each once."""
    found = runs(documents)
    twins = twin_runs(documents)
    bad, shown = garbled_runs(found, twins)
    near = found.select("k", "v", "at", "run", F.right("l", F.lit(NEAR)).alias("l"), F.left("r", F.lit(NEAR)).alias("r"))
    by_place = near.join(bad, ["l", "run", "r"]).select("k", "v", "at", "run", "clean", F.lit(1).alias("source"))
    by_twin = twins.join(shown, ["sk", "at", "run"]).select("k", "v", "at", "run", "clean", F.lit(0).alias("source"))
    # A twin's own text is better evidence than a place.
    return by_twin.unionByName(by_place).groupBy("k", "v", "at", "run").agg(F.min_by("clean", F.struct("source", "clean")).alias("clean"))


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id of the documents of which at least a part was decoded wrongly."""
    return _marked(documents).select(F.col("k").alias("doc_id")).distinct()


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_garbled, n_lost: the garbled documents with every run restored whose text is not lost."""
    fixes = _marked(documents).groupBy(F.col("k").alias("doc_id"), "v").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("clean", "run").alias("clean")))).alias("fix"),
        F.count("*").alias("n_garbled"), F.count(F.when(F.col("clean").isNull(), 1)).alias("n_lost"),
    )
    pieces = documents.select("doc_id", F.xxhash64("text").alias("v"), F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]+"), F.lit(0)).alias("r"), F.split("text", r"[^\x00-\x7F]+").alias("s"))
    rebuilt = F.expr("array_join(transform(s, (x, i) -> concat(x, coalesce(fix[i], get(r, i), ''))), '')")
    return pieces.join(fixes, ["doc_id", "v"]).select("doc_id", rebuilt.alias("text"), "n_garbled", "n_lost")
