"""Question blocks in text files: one reader, four dialects.

``stripping``: lines are stripped, blank lines end a block, the first line must be ``N. stem``, lines before
the first choice go on with the stem, lines after it are dropped, the last of equal letters wins.
``mapped``: the stem is its first line only; of equal numbers the last block wins. ``strict``: as mapped, and
exactly A to D. ``lookahead``: a block starts at every ``N. ``; other lines go on with the stem or the option
before them. ``lenient``: ``N.`` or ``N)``, letters in either case, blank lines ignored, items without a choice dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import squeeze, strip

DIALECTS = ("stripping", "mapped", "strict", "lookahead", "lenient")
_CHOICE = r"^([A-D])\.\s*(.*)$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def discovered(spark: SparkSession, root: str, globs: list[str], only: list[str] | None = None) -> DataFrame:
    """path, run: the distinct files under a root whose names match any of the globs, in order of their paths.

    ``only`` names the runs to keep; a name without a file is an error.
    """
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", g).load(root).select("path") for g in globs]
    files = reduce(DataFrame.union, found).distinct().withColumn("run", F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))
    return allowed(files, "run", only).orderBy("path")


def allowed(frame: DataFrame, column: str, only: list[str] | None) -> DataFrame:
    """The rows whose ``column`` is on the list; a name on the list that no row has is an error. No list keeps all rows."""
    if only is None:
        return frame
    kept = frame.where(F.col(column).isin(only))
    known = {r[0] for r in kept.select(column).distinct().collect()}  # at most the list's length
    if missing := sorted(set(only) - known):
        raise ValueError(f"unknown: {', '.join(missing)}")
    return kept


def read_lines(texts: DataFrame) -> DataFrame:
    """path, line_no, line: the order of lines is data, so it is kept as a number."""
    return texts.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("line_no", "line"))


def _choices(lines: Column) -> Column:
    """Letter to text, the last of equal letters."""
    marked = F.filter(lines, lambda x: x.rlike(_CHOICE))
    entries = F.transform(marked, lambda x: F.struct(F.regexp_extract(x, _CHOICE, 1).alias("key"), F.regexp_extract(x, _CHOICE, 2).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def items(texts: DataFrame, dialect: str = "stripping") -> DataFrame:
    """path, ordinal, question_number, stem, choices."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    if dialect == "lenient":
        return _lenient(texts)
    boundary = r"\n(?=\d+\.\s)" if dialect == "lookahead" else r"\n[^\S\n]*\n"
    body = F.concat(F.lit("\n"), F.regexp_replace("text", r"\r\n?", "\n"))
    blocks = texts.select("path", F.posexplode(F.split(body, boundary)).alias("ordinal", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), strip), lambda x: x != "")
    blocks = blocks.select("path", "ordinal", lines.alias("lines")).where((F.size("lines") > 0) & F.get("lines", F.lit(0)).rlike(r"^\d+\.\s*.*$"))
    number = F.regexp_extract(F.get("lines", F.lit(0)), r"^(\d+)\.", 1).try_cast("int").alias("question_number")
    head = F.regexp_replace(F.get("lines", F.lit(0)), r"^\d+\.\s*", "")
    rest = F.slice("lines", F.lit(2), F.size("lines"))
    if dialect == "lookahead":
        joined = F.aggregate(
            rest, F.array(head),
            lambda acc, x: F.when(x.rlike(_CHOICE), F.concat(acc, F.array(x))).otherwise(
                F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
            ),
        )
        folded = blocks.select("path", "ordinal", number, F.transform(joined, squeeze).alias("parts"))
        return folded.select("path", "ordinal", "question_number", F.get("parts", F.lit(0)).alias("stem"), _choices(F.slice("parts", 2, 64)).alias("choices"))
    first = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda x: x.rlike(_CHOICE)), True), F.lit(0)) - 1, F.size(rest).cast("bigint"))
    stem = F.concat_ws(" ", F.array(head), F.slice(rest, F.lit(1), first.cast("int"))) if dialect == "stripping" else head
    out = blocks.select("path", "ordinal", number, strip(stem).alias("stem"), _choices(rest).alias("choices"))
    if dialect == "stripping":
        return out
    out = out.where("stem <> ''").groupBy("path", "question_number").agg(F.max_by(F.struct("ordinal", "stem", "choices"), "ordinal").alias("x"))
    out = out.select("path", "x.ordinal", "question_number", "x.stem", "x.choices")
    return out.where(F.size("choices") == 4) if dialect == "strict" else out


def _lenient(texts: DataFrame) -> DataFrame:
    start, choice = r"^(\d+)[.)]\s*(.*)$", r"^([A-Da-d])[.)]\s*(.*)$"
    lines = read_lines(texts).select("path", "line_no", strip(F.col("line")).alias("line")).where("line <> ''")
    order = Window.partitionBy("path").orderBy("line_no")
    lines = lines.withColumn("ordinal", F.sum(F.col("line").rlike(start).cast("int")).over(order)).where("ordinal > 0")
    within = Window.partitionBy("path", "ordinal").orderBy("line_no")
    lines = lines.withColumn("part", F.sum(F.col("line").rlike(choice).cast("int")).over(within))
    parts = lines.groupBy("path", "ordinal", "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), " ")
    parts = parts.select("path", "ordinal", "part", text.alias("text"))
    return (
        parts.groupBy("path", "ordinal").agg(
            F.max(F.when(F.col("part") == 0, F.regexp_extract("text", start, 1).try_cast("int"))).alias("question_number"),
            F.max(F.when(F.col("part") == 0, F.regexp_extract("text", start, 2))).alias("stem"),
            F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", F.upper(F.regexp_extract("text", choice, 1)).alias("key"), F.regexp_extract("text", choice, 2).alias("value"))))).alias("c"),
        )
        .where(F.exists("c", lambda x: x["value"] != ""))
        .select("path", "ordinal", "question_number", "stem", F.map_from_entries(F.transform(F.filter("c", lambda e, i: ~F.exists(F.slice("c", i + 2, F.lit(64)), lambda later: later["key"] == e["key"])), lambda x: F.struct(x["key"], x["value"]))).alias("choices"))
    )


def rendered(items_: DataFrame) -> DataFrame:
    """question_number, block: the items as blocks, white space squeezed, letters in order; the inverse of ``items``."""
    options = F.transform(F.array_sort(F.map_keys("choices")), lambda k: F.concat(k, F.lit(". "), squeeze(F.col("choices")[k])))
    return items_.select("question_number", F.concat_ws("\n", F.concat(F.col("question_number").cast("string"), F.lit(". "), squeeze(F.col("stem"))), options).alias("block"))
