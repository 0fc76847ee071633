"""Parsers of spoken and printed items, as Arrow-backed functions where columns cannot express the order of steps.

Model replies are read by ``replies``, in the JVM.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ABCD"
CHOICES = T.MapType(T.StringType(), T.StringType())
_MARKER = re.compile(r"\s([a-d])\s+", re.IGNORECASE)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def peeled_options(text: str | None) -> dict[str, str]:
    """Options of a spoken item behind lone letters.

    Taken off from the right, D to A, each at the last place of its letter; where one is missing, the last four
    (or three) lone letters mark the options in the order in which they stand. Fewer than three give none.
    """
    rest, found = (text or "").strip(), {}
    for letter in reversed(LETTERS):
        marks = [m for m in re.finditer(rf"(?i)\s{letter}\s+(?=\S)", rest)]
        if not marks:
            break
        found[letter] = rest[marks[-1].end() :].strip()
        rest = rest[: marks[-1].start()].strip()
    else:
        return {k: found[k] for k in LETTERS}
    marks = list(_MARKER.finditer(text or ""))[-4:]
    if len(marks) < 3:
        return {}
    ends = [m.start() for m in marks[1:]] + [len(text)]
    options = dict.fromkeys(LETTERS, "")
    for m, end in zip(marks, ends, strict=True):
        options[m.group(1).upper()] = text[m.end() : end].strip()
    return options


def wrapped(text: str | None, most: int = 550) -> list[str]:
    """The text in pieces of at most ``most`` characters, cut at the last blank; a word longer than that is cut hard."""
    rest, out = (text or "").strip(" "), []
    while len(rest) > most:
        at = rest.rfind(" ", 1, most + 1)
        at = at if at > 0 else most
        out.append(rest[:at].strip())
        rest = rest[at:].lstrip(" ")
    return [*out, rest.strip()] if rest.strip() else out


def paragraphs(pieces: list[str]) -> str:
    """Pieces as paragraphs; where letters or digits meet at a break, a blank stays before it."""
    joints = [" " if a[-1:].isalnum() and b[:1].isalnum() else "" for a, b in zip(pieces, pieces[1:], strict=False)]
    return "\n\n".join(a + j for a, j in zip(pieces, [*joints, ""], strict=False))


def split_row(options: list[str], least: int = 15, least_rest: int = 8) -> list[str]:
    """Three rows of which the first holds two options, told by letters set apart, become four."""
    if len(options) != 3:
        return options
    for gap in (r"\s+(?=P\s+e)", r"\s+(?=T\s+o)"):
        m = re.search(gap, options[0], re.IGNORECASE)
        if m and m.start() >= least:
            first, second = options[0][: m.start()].strip(), options[0][m.end() :].strip()
            return [first, second, *options[1:]] if len(second) >= least_rest else options
    return options


def folded_options(options: list[str] | None, want: int = 4) -> list[str]:
    """Option lines brought to four, or none: one line too many joins the last, else continuations join what stands before, then the tail the last."""
    rows = split_row([_squeezed(x) for x in options or [] if x and x.strip()])
    if len(rows) == want + 1:
        return [*rows[: want - 1], " ".join(rows[want - 1 :])]
    if len(rows) <= want:
        return rows if len(rows) == want else []
    # A line goes on with the one before if it begins in lower case, or with a sum where no sentence has ended.
    goes_on = [False] + [b[0].islower() or (b[0] == "$" and a[-1] not in "?.!") for a, b in zip(rows, rows[1:], strict=False)]
    group = list(accumulate(not x for x in goes_on))
    joined = [" ".join(r for r, g in zip(rows, group, strict=True) if g == k) for k in sorted(set(group))]
    return [*joined[: want - 1], " ".join(joined[want - 1 :])] if len(joined) >= want else []


def numbered_item(lines: list[str] | None, least: int = 15, most: int = 60, own: int = 40) -> dict:
    """Stem, the options behind 1. to 4. with their wraps, and the letter of the option whose beginning the tail repeats.

    Where no option's beginning (``least`` to ``most`` characters) is in the tail, a tail that starts with a digit 1 to
    4 and repeats the first ``own`` characters of that option answers by its digit.
    """
    stem, options, tail = [], [], []
    for line in lines or []:
        m = re.match(r"\s*([1-4])\s*[.)]\s*(.*)", line)
        if m and len(options) < 4 and int(m.group(1)) == len(options) + 1:
            options.append(m.group(2))
        elif not options:
            stem.append(line)
        elif len(options) < 4 or (not tail and re.match(r"\s*[a-z$]", line)):
            options[-1] += " " + line.strip()
        else:
            tail.append(line)
    after = _squeezed(" ".join(tail)).lower()
    heads = [_squeezed(o).lower() for o in options]
    answer = next((i for i, h in enumerate(heads) if len(h) >= least and h[:most] in after), None)
    digit = re.match(r"([1-4])\s*[.)]\s*(.*)", after)
    if answer is None and digit and (i := int(digit.group(1)) - 1) < len(heads) and heads[i][:own] and digit.group(2).startswith(heads[i][:own]):
        answer = i
    return {"stem": _squeezed(" ".join(stem)), "options": [_squeezed(o) for o in options], "answer": None if answer is None else LETTERS[answer]}


def _udf(function, kind):
    @F.pandas_udf(kind)
    def run(value: pd.Series) -> pd.Series:
        return value.map(lambda x: function(None if x is None else x))

    return run


def wrapped_text(c: Column) -> Column:
    return _udf(wrapped, T.ArrayType(T.StringType()))(c)


def prose_paragraphs(c: Column) -> Column:
    return _udf(lambda x: paragraphs(wrapped(x)), T.StringType())(c)


def peeled(c: Column) -> Column:
    return _udf(peeled_options, CHOICES)(c)


def folded(c: Column) -> Column:
    return _udf(lambda x: folded_options(None if x is None else list(x)), T.ArrayType(T.StringType()))(c)


def numbered(c: Column) -> Column:
    """(stem, options, answer) of an array of lines."""
    kind = T.StructType([T.StructField("stem", T.StringType()), T.StructField("options", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType())])

    @F.pandas_udf(kind)
    def run(value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([numbered_item(None if x is None else list(x)) for x in value], columns=["stem", "options", "answer"])

    return run(c)
