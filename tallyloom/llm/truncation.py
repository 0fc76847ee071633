"""Text cut off by field limits: replies that end mid-word or mid-sentence, found in pure SQL expressions.

Word trigrams are counted inside texts and at ends (of sentences and of texts). A text is cut when its
last trigram is frequent inside and almost never terminal, or when its last word is a rare beginning of
words that often stand in that place. The word before a trigram sharpens it where that longer run is frequent,
too. Rare words fall back to one class, digits to a shape, rare trigrams to bigrams and words, so that names and sums do not hide the pattern around them.

Every text is split into words twice: once for the words that are frequent, once for the runs. The last
words of a text come from its last blanks, not from its whole length.

Defined results: null texts, texts of fewer than MIN_WORDS words and texts that end in a question mark are
never cut; equal texts get equal results and count once, however many copies there are; other marks after the last word (dots, ellipses, quotes, replacement characters, line ends) do not matter,
an open comma, semicolon or dash does, a colon is no end to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut as cut_lineage

#: a word is written out in trigrams when it makes up this share of all words or more, so at most 1 / COMMON
#: (13,333) words are, whatever the number and the length of the texts; these alone reach the driver
COMMON = 7.5e-5
MIN_GRAM, MIN_BIGRAM, MIN_WORD, MAX_TERMINAL, MAX_WORD_TERMINAL = 12, 40, 200, 0.03, 0.01
MIN_LONGER, MAX_WHOLE = 4, 0.04
MIN_WORDS = 3
#: marks and blanks that may stand after a cut or an end
_AFTER = " \t\r\n.!?…\"'“”‘’«»()[]{}<>*~|_\u00a0\u200b\u200c\u200d\ufeff\u2026\ufffd"
#: so many pieces between blanks hold the last words; where they do not, the whole text is taken
_TAIL = 9
#: counts of repeated texts are broadcast up to this number of texts
MOST_REPEATED = 200_000

_BARE = "\"“”‘«»()[]{}*~"
_PLAINER = {"…": ".", "!": ".", "?": ".", "\t": " ", "\r": " ", **dict.fromkeys("012345678", "9")}
#: their point ends no sentence
_TITLES = ("mr", "mrs", "ms", "dr", "sr", "sra")
#: A mark that becomes a word (group 1), or the point of a title (no group, so that a blank takes its place). Of several
#: marks before a blank those count that stand in the order . : ; , at the end; others belong to the word before. The group
#: comes last, for it would keep what it took in an attempt that failed.
_MARK = rf"[,;:.](?:(?= )(?<= (?:{'|'.join(_TITLES)})[.])|(?:(?= )|(?<=;)(?=, )|(?<=:)(?=;?,? )|(?<=[.])(?=:?;?,? ))(?<=([,;:.])))"


def _q(chars: str) -> str:
    return "'" + chars.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def _words(text: str, before: str = " ", after: str = " ") -> str:
    """The words of a text and its commas, colons and ends (as ".") as words of their own; pieces between blanks can be taken one by one.

    Digits become 9 and the capitals of codes one A, so that sums and codes have shapes; all else is in lower case.
    """
    plain = f"translate(replace({text}, '\\n', ' . '), {_q(''.join(_PLAINER) + _BARE)}, '{''.join(_PLAINER.values())}')"
    plain = f"concat('{before}', lower(regexp_replace({plain}, '[A-Z]++(?=-?9)', 'A')), '{after}')"
    plain = f"regexp_replace({plain}, '{_MARK}', ' $1 ')"
    return f"array_remove(split({plain}, ' '), '')"


def _shown(common: list[str]):
    """A word in a run: as it is if it is common or no word, "^" at a start, else the class of rare words."""
    known = ", ".join(_q(w) for w in common) or "''"
    return lambda w: f"if({w} < 'a' or {w} in ({known}), {w}, '<r>')"


def _context(common: list[str]) -> list[str]:
    """From words z, a, b before a word c: the contexts of three, two and one word; "^" is a start."""
    shown = _shown(common)
    one = f"if(b is null or b = '.', '^', {shown('b')})"
    two = f"if(one = '^' or a is null or a = '.', '^', {shown('a')})"
    three = f"if(a2 = '^' or z is null or z = '.', '^', {shown('z')})"
    return [one, two, three]


def _runs(words: DataFrame, common: list[str], *kept: str) -> DataFrame:
    """kept, ctx (three words), c of rows with the words z, a, b, c."""
    one, two, three = _context(common)
    return (
        words.selectExpr(*kept, "z", "a", "c", f"{one} as one").selectExpr(*kept, "z", "c", "one", f"{two} as a2")
        .selectExpr(*kept, "c", f"concat({three}, ' ', a2, ' ', one) as ctx")
    )


def _keys(runs: DataFrame, common: list[str]) -> DataFrame:
    """The runs with ``keys``: hashes of their last four words (first) to one, and of their place with the word as it stands (last)."""
    return (
        runs.withColumn("mc", F.expr(_shown(common)("c"))).withColumn("two", F.expr("substring_index(ctx, ' ', -2)"))
        .withColumn("keys", F.expr("array(xxhash64(4, ctx, mc), xxhash64(3, two, mc), xxhash64(2, substring_index(ctx, ' ', -1), mc), xxhash64(1, mc), xxhash64(0, two, c))"))
    )


def _weighted(texts: DataFrame) -> DataFrame:
    """p, share: each of n copies weighs 1 / n, so that a distinct text counts once without a shuffle of texts."""
    hashed = texts.select("p", F.xxhash64("p").alias("h"))
    repeated = cut_lineage(hashed.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"))
    if repeated.count() <= MOST_REPEATED:
        repeated = F.broadcast(repeated)
    return hashed.join(repeated, "h", "left").select("p", (1 / F.coalesce("copies", F.lit(1))).alias("share"))


def _count(share: Column) -> Column:
    return F.round(F.sum(share)).cast("bigint")


def cut_texts(texts: DataFrame, key: str, text: str, judged: str | None = None) -> DataFrame:
    """The keys of the rows of ``texts`` whose ``text`` was cut.

    All rows are counted; where a boolean column ``judged`` is named, only the ends of rows that it marks are looked at.
    """
    bare = F.expr(f"rtrim({_q(_AFTER)}, `{text}`)")
    source = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), bare.alias("p"), (F.col(judged) if judged else F.lit(True)).alias("judged"))
    weighted = _weighted(source)
    # Outer generators: else the words would be made once more for each condition that Spark infers from a generator.
    pieces = weighted.selectExpr("share", "explode_outer(split(p, ' ')) as piece").groupBy("piece").agg(F.sum("share").alias("share"))
    vocabulary = cut_lineage(pieces.selectExpr("share", f"explode_outer({_words('piece')}) as w").where("w is not null").groupBy("w").agg(_count(F.col("share")).alias("n")))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    common = sorted(r.w for r in vocabulary.where(F.col("n") >= max(3.0, COMMON * total)).select("w").collect())
    # Shifted copies of the words side by side make the runs of four words and what follows; ends stand before and after each text.
    padded = weighted.selectExpr("share", f"{_words('p', ' . . . ', ' . ')} as w")
    shifted = ", ".join(f"slice(w, {i}, size(w) - 4)" for i in range(1, 6))
    near = padded.selectExpr("share", f"inline_outer(arrays_zip({shifted})) as (z, a, b, c, d)").where("c <> '.'")
    # Keys of two strings and sums alone keep this a hash aggregation with partial counts.
    runs = _runs(near.selectExpr("share", "z", "a", "b", "c", "if(d = '.', share, 0D) as ending"), common, "share", "ending")
    counted = cut_lineage(runs.groupBy("ctx", "c").agg(_count(F.col("share")).alias("n"), _count(F.col("ending")).alias("n_end")))
    # The last words lie in the last pieces between blanks, which a text's own splitting leaves as they are.
    tail = source.where(f"judged and right(rtrim({_q(_AFTER.replace('?', ''))}, t), 1) <> '?'").selectExpr("k", "p", f"substring_index(p, ' ', -{_TAIL}) as tail")
    tail = tail.selectExpr("k", "p", "tail", f"{_words('tail')} as w")
    tail = tail.selectExpr("k", f"if(size(w) >= 4 and size(array_remove(array_remove(w, '.'), ',')) >= {MIN_WORDS} or length(tail) = length(p), w, {_words('p')}) as w")
    # The generator stands between the words and their use, so that they are made once.
    ends = tail.selectExpr(
        "k", "inline_outer(array(struct(get(w, size(w) - 4), get(w, size(w) - 3), get(w, size(w) - 2), get(w, size(w) - 1), size(array_remove(array_remove(w, '.'), ','))))) as (z, a, b, c, size)"
    ).where(f"size >= {MIN_WORDS} and c not in ('.', ':')")
    last = cut_lineage(_runs(ends, common, "k").selectExpr("k", "ctx", "c", "c in (',', ';', '–', '—') as hangs"))
    verdicts = _verdicts(counted, last.select("ctx", "c").distinct(), common)
    found = last.join(verdicts.where("is_cut"), ["ctx", "c"], "left_semi").select("k").union(last.where("hangs").select("k"))
    return found.distinct().select(F.col("k").alias(key))


def _verdicts(counted: DataFrame, finals: DataFrame, common: list[str]) -> DataFrame:
    """ctx, c, is_cut: the first level at which a final run is frequent decides, or a word that is a rare beginning of others."""
    # Beginnings are only built of the lengths that some last word has.
    lengths = finals.agg(F.collect_set(F.length("c"))).scalar()
    shorter = _keys(counted, common).withColumn("lengths", lengths).withColumn("lengths", F.filter("lengths", lambda x: x < F.length("c")))
    # One shuffle of hashes serves all levels: what is counted is n and n_end of the five keys and, as ``longer``, n of each beginning.
    stats = shorter.selectExpr(
        "inline_outer(concat(transform(keys, k -> struct(k as k, n as n, n_end as n_end, 0L as longer)),"
        " transform(lengths, x -> struct(xxhash64(0, two, left(c, x)) as k, 0L as n, 0L as n_end, n as longer))))"
    ).groupBy("k").agg(*[F.sum(x).alias(x) for x in ("n", "n_end", "longer")])
    asked = _keys(finals, common).selectExpr("ctx", "c", "posexplode_outer(keys) as (level, k)")
    at = lambda level, column: f"max(if(level = {level}, {column}, null))"
    # The end in question is no evidence for itself: it is taken out of both counts.
    seldom = lambda level, least, most: f"when {at(level, 'n')} >= {least} then {at(level, 'n_end')} - 1 <= {most} * ({at(level, 'n')} - 1)"
    by_run = f"case {seldom(0, MIN_GRAM, MAX_TERMINAL)} {seldom(1, MIN_GRAM, MAX_TERMINAL)} {seldom(2, MIN_BIGRAM, MAX_TERMINAL)} {seldom(3, MIN_WORD, MAX_WORD_TERMINAL)} else false end"
    by_start = f"coalesce({at(4, 'longer')} >= {MIN_LONGER} and {at(4, 'n')} - 1 <= {MAX_WHOLE} * {at(4, 'longer')}, false)"
    return asked.join(stats, "k").groupBy("ctx", "c").agg(F.expr(f"{by_run} or {by_start}").alias("is_cut"))


def replies(option: DataFrame, answer: DataFrame) -> DataFrame:
    """pred_id, run, reason of both kinds of run."""
    return option.select("pred_id", "run", "reason").unionByName(answer.select("pred_id", "run", "reason"))


def share_by_run(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """run, n_replies, n_cut, share_cut."""
    return (
        texts.select("pred_id", "run").join(cut.select("pred_id", F.lit(1).alias("hit")), "pred_id", "left")
        .groupBy("run").agg(F.count("*").alias("n_replies"), F.count("hit").alias("n_cut"))
        .withColumn("share_cut", F.col("n_cut") / F.col("n_replies"))
    )
