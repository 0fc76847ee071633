"""Column functions over text: normal forms, letters, tolerant JSON, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.tables import PHRASE_FIXES
from tallyloom.schema import LETTERS

SPACE = r"(?U)\s+"


def squash(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 deleted."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def spaced(c: Column, keep: str = "") -> Column:
    """Lower case, runs of all but a-z, 0-9 (and ``keep``) as one space, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^a-z0-9{keep}]+", " "))


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def valid_letter(c: Column) -> Column:
    """The trimmed upper-case letter if it is A to D, else null: blank, '?', NaN and odd letters become one null."""
    u = F.upper(strip(c))
    return F.when(u.isin(*LETTERS), u)


def letter_index(c: Column) -> Column:
    """0 to 3 of a letter, null for anything else."""
    return F.nullif(F.instr(F.lit("ABCD"), F.upper(c)), F.lit(0)) - 1


def index_letter(c: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), c)


def first_letter(c: Column) -> Column:
    """The first standalone letter A to D in either case, upper-cased; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)(?:^|[^A-Za-z0-9_])([ABCD])(?:[^A-Za-z0-9_]|$)", 1)), F.lit(""))


def last_letter(c: Column) -> Column:
    """The last standalone letter A to D."""
    return F.try_element_at(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b([ABCD])\b"), F.lit(1)), F.upper), F.lit(-1))


def final_line_letter(c: Column) -> Column:
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(r"\S"))
    return first_letter(F.try_element_at(lines, F.lit(-1)))


def token_overlap(option: Column, head: Column) -> Column:
    """Share of the option's tokens, repeats included, that the head holds; 0 without tokens."""
    tokens = F.filter(F.split(spaced(option), " "), lambda t: t != "")
    known = F.split(spaced(head), " ")
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(known, t))) / F.size(tokens))


def head_sentence(c: Column, most: int = 140) -> Column:
    """The first line, cut at its first full stop if more than three characters stand before it."""
    line = F.get(F.split(c, r"\r?\n"), F.lit(0))
    stop = F.instr(line, ".")
    return F.left(strip(F.when(stop > 4, F.substring(line, F.lit(1), stop - 1)).otherwise(line)), F.lit(most))


def tolerant_json(c: Column) -> Column:
    """The text as a variant, else what stands between its first and last brace, else null."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"\{[\s\S]*\}", 0)))


def clamped(c: Column, low: int, high: int) -> Column:
    """The whole number in the text between low and high; low where there is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(low))))


def clamp_note(c: Column, low: int, high: int) -> Column:
    """Why ``clamped`` changed a value: parse_error, clamped, or nothing."""
    n = c.try_cast("int")
    return F.when(n.isNull(), "parse_error").when(~n.between(low, high), "clamped").otherwise("")


def shortened(c: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(mark))), F.lit(mark))).otherwise(c)


def safe_name(c: Column) -> Column:
    """A file-name form: runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def percent(share: Column, places: int = 2) -> Column:
    return F.concat(F.format_number(share * 100, places), F.lit("%"))


def family(run: Column) -> Column:
    """The model family of a run: what stands before its suffixes."""
    return F.regexp_replace(F.regexp_replace(run, "_reasoned_from_.*$", ""), "(_(reasoned|two_phase|synthetic_data))+$", "")


def rotated(values: Column, number: Column) -> Column:
    """The four choices rotated left by (number - 1) mod 4."""
    r = F.pmod(number - 1, F.lit(4))
    return F.concat(F.slice(values, r + 1, F.lit(4)), F.slice(values, F.lit(1), r))


def hashed_letter(c: Column) -> Column:
    """A letter from the last hexadecimal digit of the text's SHA-256, mod 4."""
    return index_letter(F.pmod(F.conv(F.right(F.sha2(c, 256), F.lit(1)), 16, 10).cast("int"), F.lit(4)))


def filler_free(c: Column) -> Column:
    """Spoken text without fillers, without blanks before punctuation, one blank after commas, known phrases put right."""
    bare = squeeze(F.regexp_replace(squeeze(c), r"(?i)(?<![\p{L}\p{N}_])(?:uh|um|er|hm)(?![\p{L}\p{N}_])\s*", ""))
    text = F.regexp_replace(F.regexp_replace(bare, r"\s+([.,;!?])", "$1"), r",\s*", ", ")
    for said, meant in PHRASE_FIXES:
        text = F.replace(text, F.lit(said), F.lit(meant))
    return text


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def is_green(r: Column, g: Column, b: Column) -> Column:
    return (g > 0.45) & (r < 0.2) & (b < 0.45)
