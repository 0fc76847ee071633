"""Judged explanations: records with scores 0 to 3, summaries over all judged rows, conditional means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import valid_letter
from tallyloom.operators.scoring import ITEM


def eligible(replies: DataFrame, *needed: DataFrame) -> DataFrame:
    """Replies whose question (and, for some judges, whose reference) exists."""
    for frame in needed:
        replies = replies.join(frame.select(*ITEM).distinct(), ITEM, "left_semi")
    return replies


def records(replies: DataFrame, gold: DataFrame) -> DataFrame:
    """The replies (with model_option and alignment_score) beside the key; a blank choice or a missing key is never correct."""
    joined = replies.join(gold, ITEM, "left")
    choice = valid_letter(F.col("model_option"))
    return joined.select(
        "run", *ITEM, F.coalesce(choice, F.lit("")).alias("model_option"), F.coalesce("gold", F.lit("")).alias("correct_answer"),
        F.coalesce(choice == F.col("gold"), F.lit(False)).alias("is_correct"), "alignment_score",
    )


def summary(judged: DataFrame) -> DataFrame:
    """run, n_scored, accuracy, avg_alignment_score, pct_score_0 to 3; all judged rows count, blanks included."""
    n = F.count("*")
    share = lambda c: F.bround(F.count_if(c) / n, 4)
    return judged.groupBy("run").agg(
        n.alias("n_scored"), share(F.col("is_correct")).alias("accuracy"), F.bround(F.avg(F.coalesce("alignment_score", F.lit(0))), 4).alias("avg_alignment_score"),
        *[share(F.col("alignment_score") == s).alias(f"pct_score_{s}") for s in range(4)],
    )


def conditional_means(judged: DataFrame) -> DataFrame:
    """run, mean_when_correct, mean_alignment: over correct rows only, and over rows with a score; 0 without rows."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return judged.groupBy("run").agg(mean(F.when(F.col("is_correct"), F.col("alignment_score"))).alias("mean_when_correct"), mean("alignment_score").alias("mean_alignment"))
