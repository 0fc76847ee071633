"""Items from the lines of study pages: flipped cards, interactive tests, numbered cards.

Lines (path, line_no, line) get a kind once; sections are running sums over the kinds, so what stands before
or after a marker is a group of lines and no line is visited twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.functions.parsing import folded, numbered
from tallyloom.functions.text import squeeze, strip
from tallyloom.operators.balance import passes

LEAST_MARKERS, LEAST_STEM, LOOK_BACK = 10, 12, 120


def _choices(options: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCD"]), options)


def flipped_cards(lines: DataFrame) -> DataFrame:
    """path, card, stem, choices of cards that a ``Term`` or ``Definition`` line opens and a ``k of n`` line closes.

    A term shows its options last, a definition first, four of each; a card needs a stem line besides, four
    different options of two characters or more and a stem of ten. A card without its closing line is none.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    text = lines.select("path", "line_no", strip(F.col("line")).alias("line")).where("line <> ''")
    opens, closes = F.col("line").isin("Term", "Definition"), F.col("line").rlike(r"^\d+ of \d+$")
    text = text.withColumn("card", F.sum(opens.cast("int")).over(order)).where("card > 0").withColumn("opens", opens).withColumn("closes", closes)
    inside = Window.partitionBy("path", "card").orderBy("line_no")
    text = text.withColumn("closed", F.coalesce(F.max("closes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    body = F.array_sort(F.collect_list(F.when(~F.col("opens") & ~F.col("closes") & ~F.col("closed"), F.struct("line_no", "line"))))
    cards = text.groupBy("path", "card").agg(F.transform(body, lambda x: squeeze(x["line"])).alias("body"), F.max_by("line", F.col("opens").cast("int")).alias("label"), F.bool_or("closes").alias("whole"))
    n = F.size("body")
    cards = cards.where("whole and size(body) >= 5").withColumn("options", F.when(F.col("label") == "Term", F.slice("body", n - 3, F.lit(4))).otherwise(F.slice("body", 1, 4)))
    cards = cards.withColumn("rest", F.when(F.col("label") == "Term", F.slice("body", F.lit(1), n - 4)).otherwise(F.slice("body", F.lit(5), n - 4)))
    items = cards.select("path", "card", squeeze(F.array_join("rest", " ")).alias("stem"), _choices(F.col("options")).alias("choices"))
    return items.where(passes("cards", F.col("stem"), F.col("choices")))


def _kinds(lines: DataFrame) -> DataFrame:
    """The lines with their kind: dont, progress, term, skip (feedback and page junk) or text; k and of of a progress line."""
    line = strip(F.col("line"))
    kind = (
        F.when(rules.dont_know(line), "dont").when(rules.progress(line).isNotNull(), "progress").when(line.rlike(r"(?i)^T\s*e\s*r\s*m$"), "term")
        .when(rules.feedback(line) | rules.page_junk(line), "skip").otherwise("text")
    )
    return lines.select("path", "line_no", line.alias("line"), kind.alias("kind"), rules.progress(line).alias("p")).select("*", "p.k", "p.of").drop("p").where("line <> ''")


def valid_tests(kinds: DataFrame) -> DataFrame:
    """path, of: documents with ten or more progress and don't-know lines, as many don't-know lines as the test is long, and every k."""
    seen = kinds.groupBy("path").agg(F.count_if(F.col("kind") == "dont").alias("n_dont"), F.count_if(F.col("kind") == "progress").alias("n_progress"), F.max("of").alias("of"))
    long = kinds.where("kind = 'progress'").join(seen.where(f"n_dont >= {LEAST_MARKERS} and n_progress >= {LEAST_MARKERS} and n_dont = of"), ["path", "of"])
    return long.groupBy("path", "of").agg(F.count_distinct("k").alias("n")).where("n = of").select("path", "of")


def interactive_items(lines: DataFrame) -> DataFrame:
    """path, k, stem, choices of interactive tests: the k-th progress line's stem with the options above the k-th don't-know line.

    A stem is the text above its progress line back to a don't-know or term line; where that is short, the longest
    question-like text behind a term line in the LOOK_BACK lines before. Options that cannot be folded to four are
    looked for below the progress line; options that repeat those of the item before give way to those of the next.
    """
    kinds = _kinds(lines)
    kinds = kinds.join(valid_tests(kinds).withColumnRenamed("of", "long"), "path")
    order = Window.partitionBy("path").orderBy("line_no")
    mark = lambda *names: F.sum(F.col("kind").isin(*names).cast("int")).over(order)
    seen = kinds.select("*", mark("dont", "term").alias("section"), mark("dont", "term", "progress").alias("stretch"), mark("term").alias("card"), mark("dont").alias("n_dont"))
    texts = seen.where("kind = 'text'")
    joined = lambda *by: texts.groupBy("path", *by).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    said = lambda c: F.transform(c, lambda x: x["line"])
    marks = seen.where("kind = 'progress' and of = long").groupBy("path", "k").agg(F.max_by(F.struct("line_no", "section", "stretch"), "line_no").alias("at")).select("path", "k", "at.*")
    above = marks.join(joined("section"), ["path", "section"], "left").withColumn("stem", squeeze(F.array_join(said(F.filter("lines", lambda x: x["line_no"] < F.col("line_no"))), " "))).drop("lines")
    # The stretch that a don't-know line ends has the number before its own.
    options = seen.where("kind = 'dont'").select("path", F.col("n_dont").alias("k"), (F.col("stretch") - 1).alias("stretch")).join(joined("stretch"), ["path", "stretch"], "left")
    options = options.select("path", "k", folded(said("lines")).alias("options"))
    below = marks.select("path", "k", F.col("stretch")).join(joined("stretch"), ["path", "stretch"]).select("path", "k", folded(said("lines")).alias("below"))
    cards = joined("card").join(seen.where("kind = 'term'").select("path", "card", F.col("line_no").alias("opened")), ["path", "card"]).select("path", "opened", squeeze(F.array_join(said("lines"), " ")).alias("text"))
    cards = cards.where("length(text) >= 25 and (contains(text, '?') or lower(text) like '%xcep%' or length(text) > 70)")
    near = marks.join(cards, "path").where(f"opened < line_no and opened >= line_no - {LOOK_BACK}").groupBy("path", "k").agg(F.max_by("text", F.struct(F.length("text"), -F.col("opened"))).alias("from_card"))
    items = above.join(near, ["path", "k"], "left").join(options, ["path", "k"], "left").join(below, ["path", "k"], "left")
    items = items.withColumn("stem", F.when(F.length(F.coalesce("stem", F.lit(""))) >= LEAST_STEM, F.col("stem")).otherwise(F.coalesce("from_card", "stem")))
    by_k = Window.partitionBy("path").orderBy("k")
    items = items.withColumn("fold", F.when(F.size("options") == 4, F.col("options")).when(F.size("below") == 4, F.col("below")))
    items = items.withColumn("fold", F.when(F.col("fold").eqNullSafe(F.lag("fold").over(by_k)), F.coalesce(F.when(F.size(F.lead("options").over(by_k)) == 4, F.lead("options").over(by_k)), F.col("fold"))).otherwise(F.col("fold")))
    return items.where(f"fold is not null and length(stem) >= {LEAST_STEM}").select("path", F.col("k").cast("int").alias("k"), "stem", _choices(F.col("fold")).alias("choices"))


def numbered_cards(lines: DataFrame) -> DataFrame:
    """path, card, stem, choices, answer of cards with options 1 to 4 and a repeated answer; a card starts at a question-like line after its options."""
    order = Window.partitionBy("path").orderBy("line_no")
    text = lines.select("path", "line_no", strip(F.col("line")).alias("line")).where(~rules.page_junk(F.col("line")))
    option = F.col("line").rlike(r"^[1-4]\s*[.)]")
    last = F.last(F.when(option, F.regexp_extract("line", r"^([1-4])", 1)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ~option & rules.question_start(F.col("line")) & F.coalesce(last == "4", F.lit(True))
    text = text.withColumn("starts", starts)
    # Of the lines of one stem only the first opens a card: the ones after it follow no option.
    text = text.withColumn("opens", F.col("starts") & (F.coalesce(F.lag("starts").over(order), F.lit(False)) == False)).withColumn("card", F.sum(F.col("opens").cast("int")).over(order)).where("card > 0")  # noqa: E712
    cards = text.groupBy("path", "card").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    items = cards.withColumn("x", numbered(F.transform("l", lambda x: x["line"]))).select("path", "card", "x.*").where("size(options) = 4")
    return items.select("path", "card", "stem", _choices(F.col("options")).alias("choices"), "answer")
