"""Writers of questions, keys, predictions, summaries, run logs and reports.

Frames of any size go through Spark's own writers; the report renderers collect only what a page can show
and check that bound. Nothing overwrites a path that it reads: versions go to folders with a time stamp.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import squeeze
from tallyloom.schema import bucket_dimension
from tallyloom.sources.blocks import rendered

MOST_ROWS = 10_000


def _few(frame: DataFrame, most: int = MOST_ROWS) -> list:
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report shows at most {most} rows")
    return rows


def versioned(path: str, now: datetime | None = None) -> str:
    return f"{path.rstrip('/')}/{(now or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}"


def write_blocks(items: DataFrame, path: str) -> None:
    """Question blocks in order, a blank line between them."""
    rendered(items).sort("question_number").select(F.concat("block", F.lit("\n")).alias("value")).write.text(path)


def write_key(gold: DataFrame, path: str, comments: list[str] | None = None) -> None:
    """``N LETTER`` lines in order, ``?`` for unknown letters, comment lines first."""
    lines = gold.select(F.col("question_number").alias("n"), F.concat_ws(" ", F.col("question_number").cast("string"), F.coalesce("gold", F.lit("?"))).alias("value"))
    if comments:
        head = gold.sparkSession.createDataFrame([(-len(comments) + i, c if c.startswith("#") else f"# {c}") for i, c in enumerate(comments)], "n int, value string")
        lines = lines.unionByName(head)
    lines.sort("n").select("value").write.text(path)


def write_explanations(reference: DataFrame, path: str) -> None:
    lines = reference.select("question_number", F.concat_ws(" ", F.col("question_number").cast("string"), squeeze(F.col("reference"))).alias("value"))
    lines.sort("question_number").select("value").write.text(path)


def prediction_rows(items: DataFrame, predicted: DataFrame) -> DataFrame:
    """question_number, option, reason for every item; what was not answered gets a fixed message."""
    return items.select("question_number").join(predicted, "question_number", "left").select(
        "question_number", F.coalesce("option", F.lit("")).alias("option"), F.coalesce("reason", F.lit("No result.")).alias("reason")
    )


def write_csv(frame: DataFrame, path: str, order: list[str] | None = None, sep: str = ",") -> None:
    (frame.sort(*order) if order else frame).write.option("header", True).option("escape", '"').option("sep", sep).csv(path)


def write_runs(predictions: DataFrame, path: str) -> None:
    """Columnar, one folder a corpus and run, so that readers prune by both."""
    predictions.write.partitionBy("corpus", "run").parquet(path)


def write_judged(records: DataFrame, path: str) -> None:
    records.write.partitionBy("run").json(path)


def match_scores(matches: DataFrame) -> DataFrame:
    """Scores at four places and previews of 160 characters without tabs."""
    return matches.select(
        "n", F.format_number("stem_match_score", 4).alias("stem_match_score"), F.format_number("option_match_score", 4).alias("option_match_score"), "source",
        F.left(F.regexp_replace(F.col("definition"), r"[\t\r\n]+", " "), F.lit(160)).alias("definition_preview"),
    )


def public_and_labels(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without any column that gives the answer away, and the labels by id."""
    return items.drop("correct_index", "gold", "answer"), items.select("id", "correct_index").where("correct_index is not null")


def append_run(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", True).csv(path)


def log_line(log: DataFrame) -> DataFrame:
    """The rows of a run log as lines of a Markdown table; bars in notes become slashes."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "/") for c in log.columns]
    return log.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_table(frame: DataFrame, order: list | None = None) -> str:
    rows = _few(frame.sort(*order) if order else frame)
    shown = lambda x: "—" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(x) for x in r) + " |" for r in rows]) + "\n"


def leaderboard_page(accuracy: DataFrame) -> str:
    """One table a corpus, best run first."""
    corpora = [r.corpus for r in _few(accuracy.select("corpus").distinct().sort("corpus"))]
    tables = [f"## {c}\n\n" + markdown_table(accuracy.where(F.col("corpus") == c).drop("corpus"), [F.desc("pct"), F.asc("run")]) for c in corpora]
    return "# Results\n\n" + "\n".join(tables)


def verbose_page(accuracy: DataFrame) -> str:
    """The other layout of a leaderboard: a section a run with its counts, runs without a common question at 0.00 %."""
    shown = _few(accuracy.sort("corpus", F.desc("pct"), "run"))
    lines = ["# Results by run", ""]
    for r in shown:
        lines += [f"## {r.corpus} / {r.run}", "", "| Metric | Value |", "|---|---|"]
        lines += [f"| {name} | {value} |" for name, value in (("Compared", r.compared), ("Correct", r.correct), ("Wrong", r.wrong), ("Accuracy", f"{r.pct or 0:.2f}%"))] + [""]
    return "\n".join(lines)


def key_template(items: DataFrame, gold: DataFrame) -> DataFrame:
    """question_num, answer (blank), stem_preview of the items without a letter in the key, for someone to fill in."""
    open_ = items.join(gold.where("gold is not null").select("question_number"), "question_number", "left_anti")
    return open_.select(F.col("question_number").alias("question_num"), F.lit("").alias("answer"), F.left(squeeze(F.coalesce("stem", F.lit(""))), F.lit(120)).alias("stem_preview"))


def manifest(items: DataFrame) -> DataFrame:
    """source, n_items, first and last number: what each source gave."""
    return items.groupBy("source").agg(F.count("*").alias("n_items"), F.min("question_number").alias("first_number"), F.max("question_number").alias("last_number"))


def two_phase_rows(items: DataFrame, predicted: DataFrame) -> DataFrame:
    """question_number, reason_before_options, option, reason_after_options for every item, blanks where nothing was answered."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return items.select("question_number").join(predicted, "question_number", "left").select("question_number", *[blank(c) for c in ("reason_before_options", "option", "reason_after_options")])


def bucket_rows(assigned: DataFrame, model: str) -> DataFrame:
    """question_number, bucket, bucket_name, model, notes of assigned buckets, the name from the dimension."""
    named = assigned.join(F.broadcast(bucket_dimension(assigned.sparkSession)), "bucket")
    return named.select("question_number", "bucket", "bucket_name", F.lit(model).alias("model"), F.coalesce("notes", F.lit("")).alias("notes"))


def stacked_frame(summary: DataFrame) -> DataFrame:
    """run and its four score shares, chart-ready: most of the best two scores first."""
    return summary.select("run", *[f"pct_score_{i}" for i in range(4)]).sort(F.desc(F.col("pct_score_3") + F.col("pct_score_2")), "run")


def scatter_frame(summary: DataFrame) -> DataFrame:
    """run, accuracy and average score, chart-ready: best average first."""
    return summary.select("run", "accuracy", "avg_alignment_score").sort(F.desc("avg_alignment_score"), "run")


def review_page(counts: dict[str, int], exact: DataFrame, semantic: DataFrame, mapping: DataFrame) -> str:
    """Parsed, removed and kept counts, the drop lists, and old to new numbers."""
    numbers = lambda f: ", ".join(str(r[0]) for r in _few(f.sort(f.columns[0])))
    moved = "\n".join(f"- {r[0]} -> {r[1]}" for r in _few(mapping.sort(mapping.columns[0])))
    head = "Parsed / removed / kept: {parsed} / {removed} / {kept}".format(**counts)
    return f"{head}\n\nExact duplicates dropped: {numbers(exact)}\nReviewed duplicates dropped: {numbers(semantic)}\n\n{moved}\n"


def best_worst_page(extremes: DataFrame) -> str:
    return "# Best and worst bucket of each run\n\n" + markdown_table(extremes, ["corpus", "run"])


def heatmap_frame(long: DataFrame) -> DataFrame:
    """run, one column a bucket, mean: chart-ready, best mean first."""
    wide = long.groupBy("corpus", "run").pivot("bucket", list(range(1, 9))).agg(F.first("accuracy"))
    mean = long.groupBy("corpus", "run").agg(F.avg("accuracy").alias("mean"))
    return wide.join(mean, ["corpus", "run"]).sort("corpus", F.desc("mean"), "run")
