"""Rows that fail to parse: split a feed of raw records into typed rows and rejects with a reason.

Records are exploded into (row, column, value) cells, every cell meets the rules of a rule table (as one
CASE, which stands for a join with the eight rules and compiles each pattern once), the broken rules are
aggregated to one reason a row, and the clean rows are what an anti-join leaves.

Defined results: a null or blank ``answers`` record is no record (neither clean nor rejected); a null
``mcq`` record counts as one empty field and fails ``column_count``; rows with equal ids share a verdict,
the first that applies to any of them; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers keep the matcher iterative on very long records.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
MCQ_LINE = rf'(?s)\A(?:{_QUOTED}|[^",]*+)(?:,(?:{_QUOTED}|[^",]*+))*+\z'
MCQ_CELL = rf'(?s)({_QUOTED}|[^",]*+),'
KEY_LINE = r'\A[ \t]*+(?:(?:"[^"]*+"|[^" \t]++)(?:[ \t]++|\z))*+\z'
KEY_CELL = r'"[^"]*+"|[^" \t]++'
BLANK = r"(?U)\A\s*+\z"

#: feed, column position, pattern that a trimmed value must match, whether a match is wanted
RULES = [
    ("mcq", 0, r"\A0*+[1-9][0-9]*+\z", True),
    *[("mcq", i, BLANK, False) for i in range(1, 6)],
    ("answers", 0, r"\A0*+[1-9][0-9]*+[.)]?\z", True),
    ("answers", 1, r"\A[A-Da-d?]\z", True),
]
WIDTH = {"mcq": 6, "answers": 2}
FAILURES = ("quoting", "column_count", "bad_value")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s++|\s++\z", "")


def _unquoted(c: Column) -> Column:
    quoted = F.length(c).__ge__(2) & c.startswith('"') & c.endswith('"')
    return F.when(quoted, F.regexp_replace(F.expr("substring(value, 2, length(value) - 2)"), '""', '"')).otherwise(c)


def tokenised(records: DataFrame) -> DataFrame:
    """raw_id, feed, well_quoted, cells: the records with their fields still as written; blank key lines are gone."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    body = F.when(F.col("feed") == "answers", F.regexp_replace(text, r"(?s)#.*+", "")).otherwise(text)
    return (
        records.select("raw_id", "feed", body.alias("body"))
        .where(F.col("feed").isin("mcq", "answers"))
        .where((F.col("feed") == "mcq") | ~F.col("body").rlike(BLANK))
        .select(
            "raw_id",
            "feed",
            F.when(F.col("feed") == "mcq", F.col("body").rlike(MCQ_LINE)).otherwise(F.col("body").rlike(KEY_LINE)).alias("well_quoted"),
            F.when(F.col("feed") == "mcq", F.expr(f"regexp_extract_all(concat(body, ','), r'{MCQ_CELL}', 1)"))
            .otherwise(F.expr(f"regexp_extract_all(body, r'{KEY_CELL}', 0)"))
            .alias("cells"),
        )
    )


def cells(tokens: DataFrame) -> DataFrame:
    """raw_id, feed, col, value: one row for each field, unquoted and trimmed; badly quoted records keep one null cell."""
    marked = F.when(F.col("well_quoted"), F.col("cells")).otherwise(F.array(F.lit(None).cast("string")))
    exploded = tokens.select("raw_id", "feed", "well_quoted", F.size("cells").alias("width"), F.posexplode(marked).alias("col", "value"))
    return exploded.withColumn("value", trimmed(_unquoted(F.col("value"))))


def _broken(feed: Column, col: Column, value: Column) -> Column:
    """Whether a cell breaks its rule: the rule table as one CASE on feed and column, each pattern compiled once."""
    case = None
    for rule_feed, place, pattern, wanted in RULES:
        met = (feed == rule_feed) & (col == place)
        case = F.when(met, value.rlike(pattern) != F.lit(wanted)) if case is None else case.when(met, value.rlike(pattern) != F.lit(wanted))
    return F.coalesce(case, F.lit(False))


def failures(records: DataFrame) -> DataFrame:
    """raw_id, failure: the first of FAILURES that applies."""
    widths = F.create_map(*[F.lit(x) for pair in WIDTH.items() for x in pair])
    checked = cells(tokenised(records))
    rank = (
        F.when(~F.col("well_quoted"), 0)
        .when(F.col("width") != widths[F.col("feed")], 1)
        .when(_broken(F.col("feed"), F.col("col"), F.col("value")), 2)
    )
    names = F.array(*[F.lit(x) for x in FAILURES])
    return (
        checked.groupBy("raw_id").agg(F.min(rank).alias("rank")).where("rank is not null")
        .select("raw_id", names[F.col("rank")].alias("failure"))
    )


def clean(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed question rows and the typed key rows of the records without a failure."""
    good = tokenised(records).join(failures(records), "raw_id", "left_anti")
    wide = (
        cells(good).groupBy("raw_id", "feed")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("v"))
    )
    number = F.expr("try_cast(regexp_replace(v[0], '[.)]$', '') as bigint)").alias("question_number")
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    items = wide.where("feed = 'mcq'").select(
        "raw_id", number, F.col("v")[1].alias("stem"), F.map_from_arrays(letters, F.slice("v", 3, 4)).alias("choices")
    )
    keys = wide.where("feed = 'answers'").select("raw_id", number, F.nullif(F.upper(F.col("v")[1]), F.lit("?")).alias("gold"))
    return items, keys


def report(records: DataFrame) -> DataFrame:
    """file_name, feed, failure, n_rows: how many rows of each file fail, and why."""
    return (
        records.select("raw_id", "file_name", "feed").join(failures(records), "raw_id")
        .groupBy("file_name", "feed", "failure").agg(F.count("*").alias("n_rows"))
    )
