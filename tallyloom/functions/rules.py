"""Ordered first-match rules compiled to one CASE expression; the rule tables are the caller's data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.tables import FEEDBACK, PAGE_JUNK, QUESTION_STARTS, SPOKEN_ANSWERS


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Substring containment of any of the words, as one alternation."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_match(text: Column, rules: Sequence[tuple[object, Sequence[str]]], default: object) -> Column:
    """The value of the first rule of which the text contains a word."""
    (value, words), *rest = rules
    case = F.when(contains_any(text, words), F.lit(value))
    return reduce(lambda c, r: c.when(contains_any(text, r[1]), F.lit(r[0])), rest, case).otherwise(F.lit(default))


def first_pattern(text: Column, rules: Sequence[tuple[object, str]], default: object) -> Column:
    """As ``first_match`` with regular expressions."""
    (value, pattern), *rest = rules
    case = F.when(text.rlike(pattern), F.lit(value))
    return reduce(lambda c, r: c.when(text.rlike(r[1]), F.lit(r[0])), rest, case).otherwise(F.lit(default))


def junk(line: Column, patterns: Sequence[str]) -> Column:
    """Whether a line matches any of the patterns, compiled into one alternation."""
    return line.rlike("|".join(f"(?:{p})" for p in patterns))


def tagged_match(text: Column, rules: Sequence[tuple[object, str, Sequence[str]]], default: object, default_tag: str = "default") -> Column:
    """(bucket, tag) of the first rule of which the text contains a word."""
    value = first_match(text, [(v, words) for v, _, words in rules], default)
    return F.struct(value.alias("bucket"), first_match(text, [(t, words) for _, t, words in rules], default_tag).alias("tag"))


def first_of_names(text: Column, rules: Sequence[tuple[object, Sequence[str], Sequence[str]]], default: object) -> Column:
    """The value of the first rule of which the text contains a name and none of the excluded ones."""
    met = [(contains_any(text, names) & ~contains_any(text, without) if without else contains_any(text, names), value) for value, names, without in rules]
    return F.coalesce(*[F.when(m, F.lit(v)) for m, v in met], F.lit(default))


def question_start(line: Column, starts: Sequence[str] = QUESTION_STARTS, look: int = 88) -> Column:
    """A line that begins a question, also where a page sets blanks inside words."""
    bare = F.lower(F.regexp_replace(F.left(line, F.lit(look)), r"(?U)\s+", ""))
    return bare.rlike(rf"^(?:{'|'.join(map(re.escape, starts))})") | (bare.startswith("all") & F.lower(line).contains("following"))


def _squashed(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), "[^a-z0-9]", "")


def page_junk(line: Column) -> Column:
    """Blank lines, links and what a page prints around its items."""
    bare = F.trim(line)
    return (bare == "") | bare.rlike(rf"(?i)^(?:{'|'.join(PAGE_JUNK)})") | bare.rlike("(?i)https?://|www\\.")


def progress(line: Column) -> Column:
    """(k, of) of a ``k of n`` line, else null."""
    c = _squashed(line)
    at_end, at_start = r"(\d+)of(\d+)$", r"^(\d+)of(\d+)"
    pair = lambda p: F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).try_cast("int").alias("k"), F.regexp_extract(c, p, 2).try_cast("int").alias("of")))
    return F.coalesce(pair(at_end), pair(at_start))


def dont_know(line: Column) -> Column:
    return _squashed(line).contains("dontknow")


def feedback(line: Column) -> Column:
    return contains_any(_squashed(line), FEEDBACK)


def page_kind(name: Column) -> Column:
    """Numbered cards where a file's name says so, else an interactive test."""
    return F.when(F.regexp_replace(F.lower(name), " ", "").contains("qaa"), "numbered").otherwise("interactive")


def spoken_answer(text: Column, table: Sequence[tuple[str | None, str]] = SPOKEN_ANSWERS) -> Column:
    """The first of the table's patterns that the text holds gives the letter, whatever stands earlier in the text."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(letter)) if letter else F.upper(F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for letter, p in table])


NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def spoken_number(word: Column) -> Column:
    """One to ten, a misheard "n" for nine, or digits."""
    w = F.lower(word)
    case = F.when(w == "n", 9)
    for i, name in enumerate(NUMBER_WORDS, 1):
        case = case.when(w == name, i)
    return case.otherwise(w.try_cast("int"))
