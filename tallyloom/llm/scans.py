"""Noise in text from scanned pages: report the noise of each field and repair it into running text.

Whole lines that are page numbers or titles are set apart first. Titles are learnt from the corpus: a line in
a title's style that recurs at the first or last lines of a book's fields, in whatever style, a line that many
fields hold in two or more printed styles (capitals, title case, between tildes), a chapter line, or such a
title with a topic behind a bar. What is left is joined. A word split at a line end by a hyphen
mark is judged with the corpus's lexicon: the joined word against the compound.

Misread characters: a symmetric-delete index over the frequent words (all strings with up to DELETES of those
letters taken out that a scanner confuses, in words of any length) meets the same strings of the rare words; candidates are scored by an edit distance in which
pairs that scanners confuse are cheap and all other edits are not allowed in sum; the neighbouring word
picks among several, and where a field holds one misread word before different neighbours, each place is
repaired by its own. Repairs replace whole words and keep their case. A word that holds a mark inside its letters, or digits among them, needs no candidate.

Defined results: null and empty fields have no noise and stay as they are; each kind is reported once for
a field; equal fields get equal results; copies of a field do not speak
for its words, only where distinct fields leave it open do all decide; a field of one line is never a header; line ends are no noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

FIELD = ["table_name", "rec_id", "field_name"]
KEY = [*FIELD, "version"]  # rows that share an id but not their text stay apart
MIN_TITLE, MIN_STYLES = 3, 2
#: a title's line stands among a field's first or last EDGE lines, in this share of a book's fields of several lines
EDGE, MIN_SHARE = 2, 0.02
DELETES, MIN_FREQUENT, TIMES_RARER, MAX_DISTANCE = 2, 5, 10, 0.95

# What a scanner reads for what is printed, with the cost of taking the one for the other.
CONFUSIONS = [
    ("c", "e", 0.3), ("@", "a", 0.1), ("ri", "n", 0.4), ("!", "i", 0.1), ("!", "l", 0.2), ("|", "i", 0.1), ("|", "l", 0.1), ("0", "o", 0.1),
    ("1", "l", 0.1), ("1", "i", 0.2), ("+", "t", 0.1), ("cl", "d", 0.4), ("5", "s", 0.1), ("¢", "c", 0.1), ("ii", "u", 0.3), ("rn", "m", 0.3),
    ("b", "h", 0.3), ("vv", "w", 0.3), ("9", "g", 0.1), ("6", "b", 0.2), ("8", "b", 0.2), ("3", "e", 0.2), ("$", "s", 0.2), ("nn", "m", 0.4), ("li", "h", 0.4), ("tl", "d", 0.4),
    ("ﬀ", "ff", 0.1), ("ﬁ", "fi", 0.1), ("ﬂ", "fl", 0.1), ("ﬃ", "ffi", 0.1), ("ﬄ", "ffl", 0.1),
]

PAGE = r"(?i)\A[\s\[\](){}|~—–-]*+(?:(?:page|pg|p)\b\.?\s*+)?\d{1,4}(?:\s*+(?:of|/)\s*+\d{1,4})?[\s\[\](){}|~—–-]*+\z"
CHAPTER = r"(?i)\A(?:chapter|ch\.)\s*+\d++\s*+[—–:-]\s*+\S"
TILDES = r"\A~\s.*+(?<=\s~)\z"
TITLE_CASE = r"\A\p{Lu}[\p{L}’'-]*+(?:[ ,|]+(?:\p{Lu}[\p{L}’'-]*+|(?:a|an|and|at|for|in|of|on|or|the|to|with)\b))*+\z"
_L = r"[\p{L}\p{M}\d@|+¢]"
# Possessive repetitions keep the matcher iterative and linear on strings of any length.
BREAK = rf"(?<!{_L})((?:{_L}|!(?=\p{{L}})|[’'-](?={_L}))++)([-‐¬\x{{AD}}])[ \t]*+\r?\n\s*+((?:{_L}|!(?=\p{{L}}))(?:{_L}|!(?=\p{{L}})|[’'-](?={_L}))*+)"
SPLIT = r"(?<=\p{L}|\d|[@|+¢!])[-‐¬\x{AD}][ \t]*\n\s*(?=[\p{Ll}@!|+¢0159])"
NEIGHBOURS = "transform(words, (w, i) -> struct(coalesce(get(words, i - 1), '') as before, w as word))"
WORD = rf"(?:{_L}|!(?={_L}))++"
ODD = r"[@|+¢!]|[\x{FB00}-\x{FB06}]"


def fields(spark_tables: list[tuple[str, ...]]) -> DataFrame:
    """table_name, rec_id, field_name, text, book, version of (name, table, id column, text column[, book column]) entries; repeated rows once.

    Without a book column all of a table is one book.
    """
    parts = [
        t.select(F.lit(n).alias("table_name"), F.col(i).alias("rec_id"), F.lit(f).alias("field_name"), F.col(f).alias("text"), (F.col(book[0]) if book else F.lit(n)).cast("string").alias("book"))
        for n, t, i, f, *book in spark_tables
    ]
    return reduce(DataFrame.unionByName, parts).where("text is not null and text <> ''").withColumn("version", F.xxhash64("text")).distinct()


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"\|.*+\z", "")), r"[^\p{L}]+", " "))


def lines(texts: DataFrame) -> DataFrame:
    """The fields' lines in order, each with what it is: header, page (a page number, also on a header's line)."""
    split = texts.select(*KEY, "book", F.split("text", r"\r?\n").alias("ls")).select(*KEY, "book", F.posexplode("ls").alias("ln", "line"), F.size("ls").alias("n_lines"))
    bare = F.trim("line")
    numbered = r"\A\d{1,4}\s{2,}(?=\D)|(?<=\D)\s{2,}\d{1,4}\z"
    split = split.select(*KEY, "book", "ln", "line", "n_lines", F.regexp_replace(bare, numbered, "").alias("rest"), bare.rlike(numbered).alias("numbered"), bare.rlike(PAGE).alias("only"))
    style = (
        F.when(F.col("rest").rlike(TILDES), "tildes").when((F.col("rest") == F.upper("rest")) & F.col("rest").rlike(r"\p{Lu}{2}"), "capitals")
        .when(F.col("rest").rlike(TITLE_CASE), "title")
    )
    split = split.withColumn("style", F.when(F.col("n_lines") > 1, style)).withColumn("norm", F.when(F.col("style").isNotNull(), _norm(F.col("rest"))))
    edge = (F.col("ln") < EDGE) | (F.col("ln") >= F.col("n_lines") - EDGE)
    # Counted by book first: what recurs in a book, and from these counts what recurs in several styles in all books.
    by_book = split.where("norm like '% %'").groupBy("book", "norm", "style").agg(F.count("*").alias("n"), F.count_if(edge).alias("at_edge"))
    by_book = cut(by_book)
    styles = by_book.groupBy("norm").agg(F.sum("n").alias("n"), F.count_distinct("style").alias("styles")).where((F.col("n") >= MIN_TITLE) & (F.col("styles") >= MIN_STYLES)).select("norm", F.lit(True).alias("known"))
    sizes = split.where("ln = 0 and n_lines > 1").groupBy("book").agg(F.count("*").alias("n_fields"))
    running = by_book.groupBy("book", "norm").agg(F.sum("at_edge").alias("at_edge"), F.sum("n").alias("n")).join(sizes, "book")
    running = running.where((F.col("at_edge") >= F.greatest(F.lit(MIN_TITLE), F.col("n_fields") * MIN_SHARE))).select("book", "norm", F.lit(True).alias("runs"))
    named = F.coalesce(F.col("known").isNotNull() | F.col("runs").isNotNull(), F.lit(False))
    header = (F.col("n_lines") > 1) & (F.col("rest").rlike(CHAPTER) | F.coalesce(F.col("style") == "tildes", F.lit(False)) | named)
    return (
        split.join(styles, "norm", "left").join(running, ["book", "norm"], "left").withColumn("header", header & ~F.col("only"))
        .select(*KEY, "ln", "line", "header", (F.col("only") | (F.col("header") & F.col("numbered"))).alias("page"))
    )


def bodies(marked: DataFrame) -> DataFrame:
    """The fields without headers and page numbers, blank lines closed up, and whether they held any."""
    kept = F.when(~F.col("header") & ~F.col("page") & (F.trim("line") != ""), F.struct("ln", F.trim("line").alias("line")))
    return marked.groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n").alias("body"),
        F.bool_or("header").alias("header"),
        F.bool_or("page").alias("page"),
    )


def _parts(c: Column) -> Column:
    """Words in lower case, compounds in their parts, of what holds a letter."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"\p{L}"))


def breaks(body: DataFrame) -> DataFrame:
    """key, whole (the match), left, right, is_noise for each word that a hyphen mark splits at a line end."""
    compound = r"[\p{L}\p{M}\d]++(?:[’'-][\p{L}\p{M}\d]++)*+"
    lexicon = (
        body.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("body", BREAK, " ")), F.lit(compound), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    found = (
        body.select(*KEY, F.explode(F.regexp_extract_all("body", F.lit(BREAK), F.lit(0))).alias("whole"))
        .select(*KEY, "whole", F.regexp_extract("whole", BREAK, 1).alias("left"), F.regexp_extract("whole", BREAK, 3).alias("right"))
        .where(F.col("right").rlike(r"\A[\p{Ll}@!|+¢0159]") & F.col("left").rlike(r"\p{L}"))
        .withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))
    )
    wanted = found.select(F.explode(F.array("joined", "compound")).alias("word")).distinct()
    counts = cut(lexicon.join(wanted, "word", "left_semi"))
    return (
        found.join(counts.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
        .join(counts.select(F.col("word").alias("compound"), F.col("n").alias("nc")), "compound", "left")
        .select(*KEY, "whole", "left", "right", (F.coalesce("nj", F.lit(0)) >= F.coalesce("nc", F.lit(0))).alias("is_noise"))
    )


#: letters that stand in what is read, and in what is printed, of some confusion
READ, PRINTED = (re.escape("".join(sorted({c for x in CONFUSIONS for c in x[k]}))) for k in (0, 1))


def _deleted(word: Column, letters: str) -> Column:
    """The word and all strings with up to DELETES of the letters taken out; short words lose one at most, for with two they would meet everything."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)).rlike(f"[{letters}]"))
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    single = F.transform(places, lambda i: without(word, i))
    # The later letter goes first, so the place of the earlier one stays.
    double = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j < i), lambda j: without(without(word, i), j))))
    return F.array_distinct(F.concat(F.array(word), single, F.when(F.length(word) >= 6, double).otherwise(F.array().cast("array<string>"))))


def distance(read: str, printed: str) -> float:
    """Least cost of reading ``read`` for ``printed``: confusions at their cost, any other edit costs 1."""
    rows = [[9.9] * (len(printed) + 1) for _ in range(len(read) + 1)]
    rows[0][0] = 0.0
    for i in range(len(read) + 1):
        for j in range(len(printed) + 1):
            here = rows[i][j]
            if here >= 9.9:
                continue
            steps = [(1, 0, 1.0), (0, 1, 1.0), (1, 1, 0.0 if read[i : i + 1] == printed[j : j + 1] else 1.0)]
            steps += [(len(a), len(b), cost) for a, b, cost in CONFUSIONS if read.startswith(a, i) and printed.startswith(b, j)]
            for di, dj, cost in steps:
                if i + di <= len(read) and j + dj <= len(printed):
                    rows[i + di][j + dj] = min(rows[i + di][j + dj], here + cost)
    return rows[-1][-1]


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["cost"] = [distance(w, c) for w, c in zip(batch["word"], batch["candidate"], strict=True)]
        yield batch[batch["cost"] <= MAX_DISTANCE]


def misread(body: DataFrame) -> DataFrame:
    """key, before, word, repair (null where only the marks give it away): each field's misread words and the words before them."""
    words = body.select(*KEY, _parts(F.regexp_replace("body", SPLIT, "")).alias("words"))
    pairs = words.select(*KEY, F.explode(F.expr(NEIGHBOURS)).alias("x")).select(*KEY, "x.*")
    # n counts words and neighbours over distinct bodies, rows over all.
    once = body.groupBy("body").agg(F.count("*").alias("rows")).select("rows", _parts(F.regexp_replace("body", SPLIT, "")).alias("words"))
    grams = cut(once.select("rows", F.explode(F.expr(NEIGHBOURS)).alias("x")).groupBy("x.before", "x.word").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")))
    counts = grams.groupBy("word").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    marked = F.col("word").rlike(ODD) | F.col("word").rlike(r"\A(?=.*\d)(?=(?:.*\p{L}){2}).*\z")
    frequent = counts.where((F.col("rows") >= MIN_FREQUENT) & ~marked & (F.length("word") >= 2)).select(F.col("word").alias("candidate"), F.col("rows").alias("nc"), F.col("n").alias("nc_once"))
    # A misread form of a word is TIMES_RARER rarer, so a word as frequent as that of the most frequent is none.
    top = counts.agg(F.max("rows")).first()[0] or 0
    rare = counts.where(marked | ((F.length("word") >= 3) & (F.col("n") * TIMES_RARER <= top) & F.col("word").rlike("c|ri|cl|ii|rn|b|vv|nn|li|tl")))
    index = frequent.select("candidate", "nc", "nc_once", F.explode(_deleted(F.col("candidate"), PRINTED)).alias("form"))
    tried = rare.select("word", "n", "rows", F.explode(_deleted(F.col("word"), READ)).alias("form"))
    candidates = (
        tried.join(index, "form").where("word <> candidate").select("word", "n", "rows", "candidate", "nc", "nc_once").distinct()
        .where(f"nc_once > n and nc >= n * {TIMES_RARER} or nc_once = n and nc >= rows * {TIMES_RARER}").select("word", "n", "candidate", "nc").mapInPandas(_score, "word string, n bigint, candidate string, nc bigint, cost double")
    )
    candidates = cut(candidates)
    unknown = rare.where(marked).join(candidates.select("word").distinct(), "word", "left_anti").select("word")
    # The neighbour before the word picks among its candidates: how often it stands before each in the corpus.
    context = (
        grams.join(candidates, "word").select("before", "word", "candidate", "cost", "nc")
        .join(grams.select("before", F.col("word").alias("candidate"), F.col("n").alias("together")), ["before", "candidate"], "left")
        .groupBy("before", "word").agg(F.max_by("candidate", F.struct(F.coalesce("together", F.lit(0)), -F.col("cost"), "nc", "candidate")).alias("repair"))
    )
    known = pairs.join(context, ["before", "word"]).select(*KEY, "before", "word", "repair")
    return known.unionByName(pairs.join(unknown, "word", "left_semi").select(*KEY, "before", "word", F.lit(None).cast("string").alias("repair")))


def noise(texts: DataFrame) -> DataFrame:
    """table_name, rec_id, field_name, noise: one row for each kind of noise in a field."""
    body = cut(bodies(lines(texts)))
    found = [
        body.where("header").select(*KEY, F.lit("header").alias("noise")),
        body.where("page").select(*KEY, F.lit("page_number").alias("noise")),
        breaks(body).where("is_noise").select(*KEY, F.lit("hyphen").alias("noise")),
        misread(body).select(*KEY, F.lit("glyph").alias("noise")),
    ]
    return reduce(DataFrame.unionByName, found).select(*FIELD, "noise").distinct()


def _replaced(t: str, fix: str) -> str:
    """SQL: the text ``t`` with whole words changed as in ``fix`` (before, word, repair), as they stand, with a capital, and in capitals."""
    no_letter = f"(?!{_L})"
    lead = f"case when {fix}.before = '' then r'(?<!{_L})' else concat(r'(?<=(?<!{_L})(?i:\\Q', {fix}.before, r'\\E)(?!{_L}).{{1,9}}(?<!{_L}))') end"
    for form in ("{}", "concat(upper(left({}, 1)), substring({}, 2))", "upper({})"):
        word, repair = (form.replace("{}", f"{fix}.{x}") for x in ("word", "repair"))
        t = f"regexp_replace({t}, concat({lead}, r'\\Q', {word}, r'\\E{no_letter}'), {repair})"
    return t


def repaired(texts: DataFrame) -> DataFrame:
    """table_name, rec_id, field_name, text: the fields as continuous text with the noise mended."""
    body = cut(bodies(lines(texts)))
    splits = breaks(body).select(*KEY, F.struct(F.col("whole").alias("from"), F.concat("left", F.when(F.col("is_noise"), "").otherwise("-"), "right").alias("to")).alias("fix"))
    fixes = splits.groupBy(*KEY).agg(F.array_sort(F.collect_set("fix")).alias("splits"))
    # Only a word with several repairs in a field is told by the word before it.
    by_word = misread(body).where("repair is not null").groupBy(*KEY, "word").agg(F.collect_set(F.struct("before", "repair")).alias("found"), F.count_distinct("repair").alias("n"), F.min("repair").alias("repair"))
    fix = "if(n = 1, array(struct('' as before, word as word, repair as repair)), transform(found, f -> struct(f.before as before, word as word, f.repair as repair)))"
    words = by_word.select(*KEY, F.expr(f"explode({fix})").alias("fix")).groupBy(*KEY).agg(F.array_sort(F.collect_set("fix")).alias("words"))
    apply = (
        "reduce(coalesce(words, array()), regexp_replace(reduce(coalesce(splits, array()), body, (t, f) -> replace(t, f.from, f.to)), r'[ \\t]*\\n\\s*', ' '),"
        f" (t, f) -> {_replaced('t', 'f')})"
    )
    return body.join(fixes, KEY, "left").join(words, KEY, "left").select(*FIELD, F.expr(apply).alias("text"))
