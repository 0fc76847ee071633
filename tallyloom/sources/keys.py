"""Answer keys, explanation keys, predictions, buckets, items and labels from files.

Answer-key dialects: ``letters`` (``N LETTER``, A to D, comments skipped), ``any`` (any second token),
``exact`` (two tokens or an error, ``?`` kept as null), ``blank`` (blank or tab separated, A to D), ``marked``
(``N.`` or ``N)``, comments behind the letter). Of equal numbers the last line wins in all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import blank_to_null, strip, valid_letter
from tallyloom.operators.drift import column_name, fields
from tallyloom.schema import LABELS, PUBLIC_ITEM, bucket_dimension

KEY_DIALECTS = {
    "letters": r"(?i)^(\d+)\s+([ABCD?])\s*$",
    "any": r"^(\d+)\s+(\S+)",
    "exact": r"^(\d+)\s+(\S+)$",
    "blank": r"(?i)^(\d+)[ \t]+([ABCD])\s*$",
    "marked": r"(?i)^(\d+)(?:[.)]\s*|\s+)([ABCD])\s*(?:#.*)?$",
}


def answer_key(lines: DataFrame, dialect: str = "letters") -> DataFrame:
    """path, question_number, gold from (path, line_no, line)."""
    pattern = KEY_DIALECTS[dialect]
    text = lines.select("path", "line_no", strip(F.col("line")).alias("line")).where("line <> '' and not startswith(line, '#')")
    if dialect == "exact":
        text = text.withColumn("line", F.when(F.col("line").rlike(pattern), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a key line: "), "line"))))
    found = text.where(F.col("line").rlike(pattern)).select(
        "path", "line_no", F.regexp_extract("line", pattern, 1).try_cast("int").alias("question_number"), F.upper(F.regexp_extract("line", pattern, 2)).alias("letter")
    )
    if dialect == "letters":
        found = found.where("letter <> '?'")
    last = found.groupBy("path", "question_number").agg(F.max_by("letter", "line_no").alias("letter"))
    return last.select("path", "question_number", (F.nullif(F.col("letter"), F.lit("?")) if dialect in ("any", "exact") else valid_letter(F.col("letter"))).alias("gold"))


def explanation_key(lines: DataFrame, skip_comments: bool = True) -> DataFrame:
    """path, question_number, reference; with ``skip_comments`` also empty bodies are skipped."""
    pattern = r"^(\d+)\s+(.*)$" if skip_comments else r"^(\d+)\s*(.*)$"
    text = lines.select("path", "line_no", strip(F.col("line")).alias("line"))
    found = text.where(F.col("line").rlike(pattern)).select(
        "path", "line_no", F.regexp_extract("line", pattern, 1).try_cast("int").alias("question_number"), strip(F.regexp_extract("line", pattern, 2)).alias("reference")
    )
    if skip_comments:
        found = found.where("reference <> '' and not startswith(reference, '#')")
    return found.groupBy("path", "question_number").agg(F.max_by("reference", "line_no").alias("reference"))


def picked(option: Column, answer: Column, prefer: str = "option") -> Column:
    """The letter of a prediction: scorers prefer ``option``, judges ``answer``; a blank gives way to the other."""
    a, b = (option, answer) if prefer == "option" else (answer, option)
    return F.coalesce(blank_to_null(a), blank_to_null(b))


def predictions(spark: SparkSession, path: str, prefer: str = "option", keep_blank: bool = False) -> DataFrame:
    """run, question_number, letter, reason of all CSV files under a path; either column may be missing in a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return predictions_of(files, prefer, keep_blank)


def predictions_of(files: DataFrame, prefer: str = "option", keep_blank: bool = False) -> DataFrame:
    """As ``predictions``, of whole CSV files (file, text)."""
    files = files.select("file", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    # A record ends at a line end outside quotes; possessive repetitions keep the matcher linear.
    records = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(r'((?:"[^"]*+"|[^"\n]++)*+)\n'), F.lit(1))
    header = F.transform(fields(F.get(records, F.lit(0))), column_name)
    lines = files.select("file", header.alias("header"), F.posexplode(records).alias("ordinal", "line")).where("ordinal > 0 and line <> ''")
    cell = lambda name: F.get(fields(F.col("line")), (F.nullif(F.array_position("header", name), F.lit(0)) - 1).cast("int")).alias(name)
    raw = lines.select("file", "ordinal", *[cell(c) for c in ("question_number", "option", "answer", "reason")])
    rows = raw.select(
        F.regexp_extract("file", r"^(.*)\.csv$", 1).alias("run"), F.col("question_number").try_cast("int").alias("question_number"),
        picked(F.col("option"), F.col("answer"), prefer).alias("raw_letter"), "reason", "ordinal",
    ).where("question_number is not null")
    rows = rows.withColumn("letter", valid_letter(F.col("raw_letter")))
    if not keep_blank:
        rows = rows.where("letter is not null")
    return rows.groupBy("run", "question_number").agg(F.max_by(F.struct("letter", "reason"), "ordinal").alias("x")).select("run", "question_number", "x.letter", "x.reason")


def bucket_assignment(frame: DataFrame) -> DataFrame:
    """question_number, bucket, bucket_name: whole numbers 1 to 8, the name from the dimension where it is blank."""
    rows = frame.select(F.col("question_number").try_cast("int").alias("question_number"), F.col("bucket").try_cast("int").alias("bucket"), blank_to_null(F.col("bucket_name")).alias("given"))
    rows = rows.where("question_number is not null and bucket between 1 and 8")
    return rows.join(F.broadcast(bucket_dimension(frame.sparkSession)), "bucket").select("question_number", "bucket", F.coalesce("given", "bucket_name").alias("bucket_name"))


def layout(spark: SparkSession, total: int, per_bucket: int) -> DataFrame:
    """question_number, bucket of a file laid out bucket after bucket."""
    n = F.col("id").cast("int")
    return spark.range(1, total + 1).select(n.alias("question_number"), F.greatest(F.lit(1), F.least(F.lit(8), F.floor((n - 1) / per_bucket).cast("int") + 1)).alias("bucket"))


def public_items_of(lines: DataFrame) -> DataFrame:
    """Items from JSON lines (value); blank lines and lines without an id are skipped."""
    return lines.where(F.trim("value") != "").select(F.from_json("value", PUBLIC_ITEM).alias("x")).select("x.*").where("id is not null")


def labels_of(documents: DataFrame) -> DataFrame:
    """id, correct_index from JSON objects (value) that hold a map of labels."""
    return documents.select(F.explode(F.from_json("value", LABELS)["labels"]).alias("id", "label")).select("id", "label.correct_index")


def public_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PUBLIC_ITEM).json(path).where("id is not null")


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).option("multiLine", True).json(path).select(F.explode("labels").alias("id", "label")).select("id", "label.correct_index")


def run_of(path: Column) -> Column:
    """The run a file holds: its name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def judge_summary(frame: DataFrame) -> DataFrame:
    return frame.where(blank_to_null(F.col("run")).isNotNull())
