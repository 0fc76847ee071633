"""Sequence likeness and the arg-max joins built on it."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import squash

STEM_REJECT, STEM_BUMP, STEM_PREFIX, STEM_CAP = 0.44, 0.72, 20, 48
LINE_BUMP, LINE_PREFIX, LINE_CAP, LINE_SHORTEST, LINE_TRY_BELOW = 0.78, 22, 52, 12, 0.55


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff and Obershelp's measure as the standard library computes it; the order of arguments matters."""
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


_SYMBOLS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def _letter_counts(text: str) -> np.ndarray:
    return np.bincount([_SYMBOLS[c] for c in text if c in _SYMBOLS], minlength=len(_SYMBOLS)) if text else np.zeros(len(_SYMBOLS), dtype=np.int64)


class Bank:
    """Finds the entry of a bounded bank that is most like a squashed text.

    No ratio exceeds twice the common letters over all letters, so entries are tried from the highest such bound on
    and the rest is left out once it cannot win; the result is that of trying all. What the measure prepares of an
    entry is kept from text to text.
    """

    def __init__(self, entries: list[tuple[int, str]], bump: float, prefix: int, cap: int):
        self.entries, self.bump, self.prefix, self.cap = entries, bump, prefix, cap
        self.counts = np.array([_letter_counts(t) for _, t in entries]).reshape(len(entries), len(_SYMBOLS))
        self.lengths = self.counts.sum(axis=1)
        self.matchers: dict[int, SequenceMatcher] = {}

    def score(self, i: int, text: str) -> float:
        if i not in self.matchers:
            if len(self.matchers) >= 20_000:
                self.matchers.clear()
            self.matchers[i] = SequenceMatcher(None, "", self.entries[i][1])
        self.matchers[i].set_seq1(text)
        return self.matchers[i].ratio()

    def best(self, text: str, least: float) -> tuple[int, float] | None:
        """(entry, score) of the first of the best entries with a score of ``least`` or more."""
        if not self.entries:
            return None
        own = _letter_counts(text)
        total = self.lengths + own.sum()
        bound = np.where(total > 0, 2.0 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(total, 1), 1.0)
        n = [min(len(text), len(t), self.cap) for _, t in self.entries]
        same = np.array([k > self.prefix and text[:k] == t[:k] for k, (_, t) in zip(n, self.entries, strict=True)])
        bound = np.where(same, np.maximum(bound, self.bump), bound)
        found: tuple[float, int] | None = None
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < max(least, found[0] if found else 0.0) - 1e-12:
                break
            score = max(self.score(i, text), self.bump if same[i] else 0.0)
            # Of equal scores the first entry wins.
            if score >= least and (found is None or (score, -self.entries[i][0]) > (found[0], -self.entries[found[1]][0])):
                found = (score, i)
        return None if found is None else (found[1], found[0])


def _arg_max(stems: DataFrame, bank: list[tuple[int, str]], bump: float, prefix: int, cap: int) -> DataFrame:
    """id, pos, score of stems (id, s, least) by a bank (pos, squashed text), which every task holds."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Bank(bank, bump, prefix, cap)
        for batch in batches:
            hits = [(i, held.best(s or "", least)) for i, s, least in zip(batch["id"], batch["s"], batch["least"], strict=True)]
            yield pd.DataFrame([(i, bank[h[0]][0], h[1]) for i, h in hits if h], columns=["id", "pos", "score"])

    kind = stems.schema["id"].dataType.simpleString()
    return stems.select("id", "s", "least").mapInPandas(scan, f"id {kind}, pos int, score double")


def _bank(frame: DataFrame, most: int) -> list[tuple[int, str]]:
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a bank of more than {most} entries needs blocking first")
    return sorted((r.pos, r.t or "") for r in rows)


def best_terms(stems: DataFrame, terms: DataFrame, most_terms: int = 50_000) -> DataFrame:
    """id, pos, term, definition, score: for each stem the first of the terms most alike, rejected below STEM_REJECT.

    ``stems`` has id and stem; ``terms`` has pos, term and definition and is a bounded bank, checked here.
    """
    bank = _bank(terms.select("pos", squash(F.col("term")).alias("t")), most_terms)
    left = stems.select("id", squash(F.col("stem")).alias("s"), F.lit(STEM_REJECT).alias("least"))
    best = _arg_max(left, bank, STEM_BUMP, STEM_PREFIX, STEM_CAP)
    return best.join(F.broadcast(terms.select("pos", "term", "definition")), "pos").select("id", "pos", "term", "definition", "score")


def best_lines(stems: DataFrame, lines: DataFrame, found: DataFrame, most_lines: int = 200_000) -> DataFrame:
    """The fallback for stems without a good term: the most alike raw line, if it is as good as what was found."""
    squashed = lines.select("pos", "line", squash(F.col("line")).alias("t")).where(F.length("t") >= LINE_SHORTEST)
    bank = _bank(squashed.select("pos", "t"), most_lines)
    open_ = stems.join(found.select("id", "score"), "id", "left").where(F.coalesce("score", F.lit(0.0)) < LINE_TRY_BELOW)
    left = open_.select("id", squash(F.col("stem")).alias("s"), F.coalesce("score", F.lit(0.0)).alias("least"))
    best = _arg_max(left, bank, LINE_BUMP, LINE_PREFIX, LINE_CAP)
    return best.join(F.broadcast(squashed.select("pos", "line")), "pos").select("id", "pos", "line", "score")


@F.pandas_udf(T.StructType([T.StructField("letter", T.StringType()), T.StructField("score", T.DoubleType())]))
def _best_option(definition: pd.Series, options: pd.Series) -> pd.DataFrame:
    def pick(text: str | None, choices: dict | None) -> tuple[str, float]:
        target = "".join(c for c in (text or "").lower() if c.isascii() and c.isalnum())
        best, letter, anyway = 0.0, None, ("A", -1.0)
        for name, option in sorted((choices or {}).items()):
            o = "".join(c for c in (option or "").lower() if c.isascii() and c.isalnum())
            score = ratio(target, o)
            if score > anyway[1]:
                anyway = (name, score)
            if len(o) < 6:
                continue
            if target in o or o in target:
                score = max(score, 0.88)
            elif len(target) > 25 and len(o) > 25 and target[:28] == o[:28]:
                score = max(score, 0.75)
            if score > best:
                best, letter = score, name
        return (letter, best) if letter else anyway

    return pd.DataFrame([pick(d, dict(o) if o is not None else None) for d, o in zip(definition, options, strict=True)], columns=["letter", "score"])


def best_option(definition: Column, choices: Column) -> Column:
    """Letter and score of the option most like a definition; the earliest letter wins a tie."""
    return _best_option(definition, choices)
