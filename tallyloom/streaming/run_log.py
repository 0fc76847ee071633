"""Append-only run results as streams: accuracies that follow the files as they come, windows with late rows, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import valid_letter
from tallyloom.sources.sinks import log_line


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_accuracy(replies: DataFrame, gold: DataFrame, letter: str = "option") -> DataFrame:
    """corpus, run, compared, correct: for update or complete mode; the key is a static side."""
    valid = replies.select("corpus", "run", "question_number", valid_letter(F.col(letter)).alias("letter")).where("letter is not null")
    joined = valid.join(gold, ["corpus", "question_number"])
    return joined.groupBy("corpus", "run").agg(F.count("*").alias("compared"), F.count_if(F.col("letter") == F.col("gold")).alias("correct"))


def windowed_counts(replies: DataFrame, time: str = "answered_at", width: str = "1 day", late: str = "30 days") -> DataFrame:
    """window_start, run, n: replies a window; rows later than the watermark no longer count."""
    counted = replies.withWatermark(time, late).groupBy(F.window(time, width), "run").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "run", "n")


def without_redelivered(replies: DataFrame, time: str = "loaded_at", late: str = "60 days") -> DataFrame:
    """Each reply once, although files repeat rows under new ids; state is dropped behind the watermark."""
    return replies.withWatermark(time, late).dropDuplicatesWithinWatermark(["corpus", "run", "question_number", "answered_at"])


def run_log_writer(csv_path: str, table_path: str):
    """For ``foreachBatch``: appends a batch to the CSV log and its lines to the Markdown log; batches are told apart by folder, so a repeated one does no harm."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{csv_path}/batch={number}")
        log_line(batch).write.mode("overwrite").text(f"{table_path}/batch={number}")

    return write


def drained(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream has once it has read all that is there, as a table in memory (for tests and small logs)."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
