"""Parsers of free-text model replies as column expressions.

Strategies with different results stay apart by name: ``strict`` reads labelled lines and what is left of
them, ``simple`` takes any letter on a labelled line, ``loose`` infers from phrases, ``forced`` always gives a
letter. A reply is split into its lines once; what a line says is one expression, so all of it stays in the JVM.

Defined results: a null reply has no lines; where a letter is not found it is null (``forced`` takes it from
the stem's hash); a reason that is not found is the whole reply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.tables import DOMAIN_WORDS, ECHO_MARKERS, ECHO_NEEDLES
from tallyloom.functions.text import hashed_letter, squeeze, strip

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
LABEL = r"(?is)^(?:OPTION|ANSWER):(.*)$"
PHRASES = [
    r"\bOPTION\s*[:=]\s*([A-D])\b", r"\bANSWER\s*[:=]\s*([A-D])\b", r"\b(?:THE\s+)?(?:CORRECT\s+)?(?:ANSWER|CHOICE|OPTION)\s+IS\s+([A-D])\b", r"\b(?:CHOOSE|SELECT|PICK)\s+([A-D])\b",
]
FORCING = [r"\bCORRECT\s+(?:ANSWER|OPTION)\s+IS\s+([A-D])\b", r"\b(?:ANSWER|CHOICE)\s+IS\s+([A-D])\b", r"\bOPTION\s+([A-D])\b"]
NO_REASON = "No concise justification could be extracted."
NO_REASON_FORCED = "The letter was inferred; the reply holds no usable justification."


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, so that expressions built of expressions do not multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def _last(values: Column) -> Column:
    return F.try_element_at(_present(values), F.lit(-1))


def whole(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\0"), F.lit("")))


def lines(c: Column) -> Column:
    """The lines of a reply that are not blank, stripped."""
    return F.filter(F.transform(F.split(whole(c), LINE_END), strip), lambda x: x != "")


def is_echoed_choice(line: Column) -> Column:
    """A pasted ``A. `` to ``D. `` line with twelve characters or more."""
    return strip(line).rlike(r"^[A-D]\.\s+.{12,}")


def _line_letter(line: Column) -> Column:
    upper = F.upper(line)
    choice = F.when(F.length(line) < 120, _found(line, r"(?i)^([A-D])\s*[.):\-–]\s*(?:$|\S)"))
    said = F.upper(F.coalesce(*[_found(upper, p) for p in PHRASES], choice, _found(line, r"(?i)^\(?([A-D])\)?\s*$")))
    return F.when(is_echoed_choice(line) & (F.length(line) > 50), F.lit(None).cast("string")).otherwise(said)


def _loose(every: Column) -> Column:
    tail = lambda said: F.slice(said, F.greatest(F.size(said) - 11, F.lit(1)), F.lit(12))
    return let(F.transform(every, _line_letter), lambda said: F.coalesce(_last(tail(said)), F.try_element_at(_present(said), F.lit(1))))


def loose_letter(c: Column) -> Column:
    """A letter inferred line by line: the last of the last twelve lines, else the first of all; long pasted choices say nothing."""
    return _loose(lines(c))


def _labelled(every: Column) -> Column:
    return F.filter(F.slice(every, 1, 12), lambda x: x.rlike(LABEL))


def _from_reason(every: Column, stop: str) -> Column:
    """The lines from the first ``REASON:`` up to the first that matches ``stop``; none without such a line."""
    starts = F.array_position(F.transform(every, lambda x: x.rlike("(?i)^REASON:")), F.lit(True)).cast("int")
    rest = F.when(starts > 0, F.slice(every, F.greatest(starts, F.lit(1)), F.greatest(F.size(every), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    ends = lambda r: F.array_position(F.transform(r, lambda x: x.rlike(stop)), F.lit(True)).cast("int")
    return let(rest, lambda r: let(ends(r), lambda n: F.when(n > 0, F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(r)))


def _block(every: Column) -> Column:
    """What stands behind ``REASON:`` up to the next option or answer line."""
    return strip(F.array_join(F.transform(_from_reason(every, LABEL), lambda x: strip(F.regexp_replace(x, "(?i)^REASON:", ""))), " "))


def strict(c: Column) -> Column:
    """(letter, reason): the last leading letter of a labelled line among the first twelve, else a loose one; the reason's block, else a long "because"."""

    def read(every: Column) -> Column:
        letter = _last(F.transform(_labelled(every), lambda x: F.regexp_extract(F.upper(x), r"^(?:OPTION|ANSWER):\s*([A-D])\b", 1)))
        because = F.transform(_labelled(every), lambda x: strip(F.regexp_extract(x, r"(?is)^[^:]*:.*?\b(?:BECAUSE|SINCE|AS)\b(.*)$", 1)))
        reason = F.coalesce(F.nullif(_block(every), F.lit("")), _last(F.filter(because, lambda x: F.length(x) > 15)), whole(c), F.lit(""))
        return F.struct(F.coalesce(letter, _loose(every)).alias("letter"), reason.alias("reason"))

    return let(lines(F.coalesce(c, F.lit(""))), read)


def simple(c: Column) -> Column:
    """(letter, reason): the first letter of the last labelled line that holds any (an echoed list of all four gives A); the last reason line."""

    def read(every: Column) -> Column:
        letter = _last(F.transform(_labelled(every), lambda x: F.regexp_extract(F.upper(x), r"\b([A-D])\b", 1)))
        behind = F.filter(F.slice(every, 1, 12), lambda x: x.rlike("(?i)^REASON:"))
        said = F.try_element_at(F.transform(behind, lambda x: strip(F.regexp_replace(x, "(?i)^REASON:", ""))), F.lit(-1))
        reason = F.coalesce(F.nullif(said, F.lit("")), F.nullif(whole(c), F.lit("")), F.lit("PARSE_FAILED: empty response"))
        return F.struct(letter.alias("letter"), reason.alias("reason"))

    return let(lines(F.coalesce(c, F.lit(""))), read)


def forced(c: Column, stem: Column) -> Column:
    """A phrase's letter, else the last standalone letter, else one from the SHA-256 of the stem."""
    upper = F.upper(F.replace(c, F.lit("\0"), F.lit("")))
    last = F.try_element_at(F.regexp_extract_all(upper, F.lit(r"\b([A-D])\b"), F.lit(1)), F.lit(-1))
    return F.coalesce(*[_found(upper, p) for p in FORCING], last, hashed_letter(F.coalesce(stem, F.lit(""))))


def is_echo(c: Column) -> Column:
    """The text repeats its instructions, or holds two options."""
    marked = lambda upper: reduce(lambda a, b: a | b, [upper.contains(m) for m in ECHO_MARKERS]) | (F.regexp_count(upper, F.lit("OPTION:")) > 1)
    return F.coalesce(let(F.upper(c), marked), F.lit(False))


def keyword_reason(c: Column) -> Column:
    """What stands behind the first ``REASON:`` line up to a blank line or a labelled line."""
    plain = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), LINE_END, "\n")
    block = F.regexp_extract(plain, r"(?i)(?:^|\n)[ \t]*REASON:((?:(?!\n\s*(?:OPTION|ANSWER):)(?!\n[ \t]*(?:\n|$))[\s\S])*+)", 1)
    return squeeze(F.regexp_replace(block, r"(?i)\n[ \t]*REASON:", " "))


def narrative(raws: Column) -> Column:
    """The longest prose of the replies (25 characters or more, no echo, the first of equals), labels and pasted choices left out; at most 500 characters."""
    noise = r"(?i)^(?:LINE [12]:|OUTPUT EXACTLY|FORMAT FIX\.|Question\s+\d+\s*:)"

    def said(line: Column) -> Column:
        tail = let(strip(F.regexp_replace(strip(F.regexp_extract(line, LABEL, 1)), r"(?i)^[A-D]\b\s*", "")), lambda t: F.when(F.length(t) > 25, t).otherwise(""))
        return (
            F.when((is_echoed_choice(line) & (F.length(line) > 45)) | line.rlike(noise), "").when(line.rlike(LABEL), tail)
            .when(line.rlike("(?i)^REASON:"), strip(F.regexp_replace(line, "(?i)^REASON:", ""))).otherwise(line)
        )

    prose = F.transform(raws, lambda r: squeeze(F.array_join(_present(F.transform(lines(r), said)), " ")))
    fit = F.filter(prose, lambda p: (F.length(p) >= 25) & ~is_echo(p))
    longest = lambda f: let(F.array_max(F.transform(f, F.length)), lambda most: F.try_element_at(F.filter(f, lambda p: F.length(p) == most), F.lit(1)))
    return F.left(let(fit, longest), F.lit(500))


def clean_reason(reason: Column, raws: Column, was_forced: Column) -> Column:
    """A reason of at most 500 characters: itself, a later reply's block, the first fitting sentence of the first reply, its prose, or a fixed message."""
    own = let(squeeze(F.coalesce(reason, F.lit(""))), lambda r: F.when((r != "") & ~is_echo(r) & (F.lower(r) != NO_REASON.lower()), F.left(r, F.lit(500))))
    blocks = F.filter(F.transform(F.reverse(raws), keyword_reason), lambda x: (x != "") & ~is_echo(x))
    later = F.left(F.try_element_at(blocks, F.lit(1)), F.lit(500))
    blob = F.regexp_replace(squeeze(F.replace(F.coalesce(F.try_element_at(raws, F.lit(1)), F.lit("")), F.lit("\0"), F.lit(""))), r"\b[ABCD]\.\s*", " ")
    sentences = F.transform(F.split(blob, r"(?<=[.!?])\s+"), strip)
    sentence = F.try_element_at(F.filter(sentences, lambda x: F.length(x).between(25, 500) & ~is_echo(x)), F.lit(1))
    return F.coalesce(own, later, sentence, narrative(raws), F.when(was_forced, NO_REASON_FORCED).otherwise(NO_REASON))


def _before_needles(text: Column, needles: list[str], least: int) -> Column:
    """The text up to the first of each needle that has ``least`` characters before it, one needle after the other."""
    ends = lambda t, n: let(F.locate(n, F.lower(t)) if isinstance(n, str) else F.call_function("instr", F.lower(t), n), lambda at: F.when(at > least, strip(F.left(t, at - 1))).otherwise(t))
    return F.aggregate(F.array(*[F.lit(n) for n in needles]), text, ends)


def exported_reason(reason: Column, domain: list[str] = DOMAIN_WORDS) -> Column:
    """The reason without the instructions that follow it; a long one without a word of the subject gives way to its last ``REASON:`` block."""
    text = _before_needles(squeeze(F.replace(F.coalesce(reason, F.lit("")), F.lit("\0"), F.lit(""))), ECHO_NEEDLES, 20)
    text = strip(F.regexp_replace(text, r"(?i)^\s*Question\s+\d+\s*:\s*", ""))
    tail = _before_needles(squeeze(F.try_element_at(F.split(reason, r"(?i)\bREASON:\s*"), F.lit(-1))), ["output format (exactly", "first line:", "format fix."], 15)
    labelled = reason.rlike(r"(?i)\bREASON:")
    stray = lambda t: (F.length(t) > 180) & ~t.rlike(rf"(?i)\b(?:{'|'.join(domain)})\b") & labelled
    pick = lambda t: F.when(stray(t), let(tail, lambda u: F.when(F.length(u) >= 15, u).otherwise(t))).otherwise(t)
    return strip(F.left(let(text, pick), F.lit(500)))


def first_phase(c: Column) -> Column:
    """From the reason's label to the option's line, else the whole text, squeezed."""
    kept = _from_reason(lines(c), "(?i)^OPTION:")
    said = let(kept, lambda k: F.when(F.size(k) > 0, squeeze(F.regexp_replace(F.array_join(k, " "), "(?i)^REASON:", ""))))
    return F.coalesce(said, F.nullif(squeeze(whole(c)), F.lit("")), F.lit("PARSE_FAILED: empty phase-1 response"))
