"""Record types of the evaluation data model and its small constant dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LETTERS = ("A", "B", "C", "D")

# The eight topic buckets, in order.
BUCKETS = (
    (1, "Basic concepts"),
    (2, "Contract law"),
    (3, "CA laws & ethics"),
    (4, "Tort & property fundamentals"),
    (5, "Residential property"),
    (6, "Valuation & government programs"),
    (7, "Personal liability & inland marine"),
    (8, "Commercial insurance"),
)

ITEM = T.StructType(
    [
        T.StructField("corpus", T.StringType()),
        T.StructField("question_number", T.IntegerType()),
        T.StructField("stem", T.StringType()),
        T.StructField("choices", T.MapType(T.StringType(), T.StringType())),
    ]
)
PREDICTION = T.StructType([T.StructField(n, T.StringType()) for n in ("question_number", "answer", "option", "reason")])
PUBLIC_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StructType([T.StructField("correct_index", T.IntegerType())]))),
    ]
)
JUDGE_RECORD = T.StructType(
    [
        T.StructField("question_number", T.IntegerType()),
        T.StructField("model_option", T.StringType()),
        T.StructField("correct_answer", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("alignment_score", T.IntegerType()),
        T.StructField("notes", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
    ]
)


def bucket_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUCKETS), "bucket int, bucket_name string")
