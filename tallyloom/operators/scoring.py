"""Letters against keys: overlap joins, accuracies, dense bucket tables, leaderboards.

Three denominators are kept apart by name: ``run_accuracy`` counts the overlap of valid letters,
``judge`` counts all judged rows, ``labelled_accuracy`` counts all labelled questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import family, valid_letter
from tallyloom.schema import LETTERS, bucket_dimension

ITEM = ["corpus", "question_number"]


def last_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each key; ties of the order go to the greatest value."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def gold_key(answers: DataFrame) -> DataFrame:
    """corpus, question_number, gold: the letter keyed last among the valid ones."""
    valid = answers.select(*ITEM, valid_letter(F.col("answer")).alias("gold"), "keyed_at").where("gold is not null")
    return last_wins(valid, ITEM, "gold", ["keyed_at"])


def run_letters(predictions: DataFrame, letter: str) -> DataFrame:
    """corpus, run, question_number, letter: of re-delivered replies the one answered last; only valid letters stay."""
    valid = predictions.select(*ITEM, "run", valid_letter(F.col(letter)).alias("letter"), "answered_at", "pred_id").where("letter is not null")
    return last_wins(valid, ["corpus", "run", "question_number"], "letter", ["answered_at", "pred_id"])


def all_letters(option: DataFrame, answer: DataFrame) -> DataFrame:
    return run_letters(option, "option").unionByName(run_letters(answer, "answer"))


def overlap(letters: DataFrame, gold: DataFrame) -> DataFrame:
    """The replies whose question has a key, with whether they are right."""
    return letters.join(gold, ITEM).withColumn("correct", F.col("letter") == F.col("gold"))


def _rate(correct: Column, n: Column, places: int = 5) -> Column:
    return F.when(n > 0, F.bround(correct / n, places))


def run_accuracy(letters: DataFrame, gold: DataFrame) -> DataFrame:
    """corpus, run, compared, correct, wrong, pct."""
    agg = overlap(letters, gold).groupBy("corpus", "run").agg(F.count("*").alias("compared"), F.count_if("correct").alias("correct"))
    return agg.select("corpus", "run", "compared", "correct", (F.col("compared") - F.col("correct")).alias("wrong"), F.bround(F.col("correct") * 100 / F.col("compared"), 2).alias("pct"))


def bucket_accuracy(letters: DataFrame, gold: DataFrame, buckets: DataFrame) -> DataFrame:
    """corpus, run, bucket, n, correct of the buckets that occur."""
    joined = overlap(letters, gold).join(buckets, ITEM)
    return joined.groupBy("corpus", "run", "bucket").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def dense(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Every run of ``runs`` beside all eight buckets; empty ones with n = 0 and a null accuracy."""
    grid = runs.select("corpus", "run").distinct().join(F.broadcast(bucket_dimension(stats.sparkSession)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return grid.join(stats, ["corpus", "run", "bucket"], "left").select(
        "corpus", "run", "bucket", "bucket_name", zero("n"), zero("correct"), _rate(F.col("correct"), F.col("n")).alias("accuracy")
    )


def best_and_worst(long: DataFrame) -> DataFrame:
    """corpus, run, best_bucket, best_accuracy, worst_bucket, worst_accuracy; the first bucket wins ties, runs without data are left out."""
    have = long.where("accuracy is not null")
    best, worst = F.struct("accuracy", -F.col("bucket")), F.struct("accuracy", "bucket")
    return have.groupBy("corpus", "run").agg(
        F.max_by("bucket", best).alias("best_bucket"), F.max("accuracy").alias("best_accuracy"), F.min_by("bucket", worst).alias("worst_bucket"), F.min("accuracy").alias("worst_accuracy")
    )


def mean_rates(long: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of the accuracies that are not null."""
    return long.groupBy(*by).agg(F.bround(F.avg("accuracy"), 5).alias("mean_accuracy"), F.count("accuracy").alias("n_rates"))


def family_means(accuracy: DataFrame, corpora: list[str]) -> DataFrame:
    """family, one column a corpus, mean_pct: the mean over the corpora that are present."""
    wide = accuracy.groupBy(family(F.col("run")).alias("family")).pivot("corpus", corpora).agg(F.avg("pct"))
    shown = [F.bround(c, 2).alias(c) for c in corpora]
    present = F.array_compact(F.array(*corpora))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return wide.select("family", *shown, F.bround(total / F.size(present), 2).alias("mean_pct"))


def leaderboard(accuracy: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """The rank of each row within ``by``: score downwards, name upwards."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(name))
    return accuracy.withColumn("rank", F.row_number().over(order))


def labelled_accuracy(items: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """run, total, correct, accuracy over all labelled items; a reply without a letter is wrong, not left out."""
    wanted = labels.join(items.select("id").distinct(), "id", "left_semi")
    # Every run has the same total, so no run needs a row beside every item.
    total = wanted.agg(F.count("*")).scalar()
    right = predictions.join(wanted, "id", "left").groupBy("run").agg(F.count_if(F.col("pred_index") == F.col("correct_index")).alias("correct"))
    agg = right.select("run", total.alias("total"), "correct")
    return agg.withColumn("accuracy", F.bround(F.col("correct") / F.col("total"), 6))


def constant_baseline(items: DataFrame, labels: DataFrame, letter: str = "A") -> DataFrame:
    """The accuracy of answering one letter to everything."""
    return labelled_accuracy(items, items.select(F.lit("constant").alias("run"), "id", F.lit(LETTERS.index(letter)).alias("pred_index")), labels)


def coverage(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """corpus, unanswered, unasked, mismatch: questions without a key, keys without a question, and both together."""
    both = questions.select(*ITEM, F.lit(1).alias("q")).distinct().join(gold.select(*ITEM, F.lit(1).alias("k")), ITEM, "full_outer")
    lacking_key, lacking_question = F.count_if(F.col("k").isNull()), F.count_if(F.col("q").isNull())
    return both.groupBy("corpus").agg(lacking_key.alias("unanswered"), lacking_question.alias("unasked"), (lacking_key + lacking_question).alias("mismatch"))


def missing_keys(questions: DataFrame, gold: DataFrame) -> DataFrame:
    return questions.select(*ITEM).distinct().join(gold, ITEM, "left_anti")


def accuracy_rollup(letters: DataFrame, gold: DataFrame, buckets: DataFrame) -> DataFrame:
    """corpus, run, bucket, n, correct at three levels in one pass (grouping sets)."""
    joined = overlap(letters, gold).join(buckets, ITEM)
    agg = joined.groupingSets([("corpus", "run", "bucket"), ("corpus", "run"), ("corpus",)], "corpus", "run", "bucket")
    return agg.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.count_if("correct").alias("correct"))
