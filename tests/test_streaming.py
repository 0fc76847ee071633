from datetime import datetime

from tallyloom.streaming import run_log

SCHEMA = "pred_id bigint, corpus string, run string, question_number int, option string, answered_at timestamp, loaded_at timestamp"


def test_running_accuracy_follows_files(spark, tmp_path):
    gold = spark.createDataFrame([("c", 1, "A"), ("c", 2, "B")], "corpus string, question_number int, gold string")
    at = datetime(2025, 1, 1)
    for n, letters in enumerate((["A", "C"], ["a", "B", None])):
        spark.createDataFrame([(n * 10 + i, "c", "r", i % 2 + 1, x, at, at) for i, x in enumerate(letters)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    live = run_log.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = run_log.drained(run_log.running_accuracy(live, gold), "acc").collect()
    assert [tuple(r) for r in got] == [("c", "r", 4, 3)]


def test_redelivered_rows_count_once(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [(1, "c", "r", 1, "A", at, at), (2, "c", "r", 1, "A", at, datetime(2025, 1, 9)), (3, "c", "r", 2, "A", at, at)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    live = run_log.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert run_log.drained(run_log.without_redelivered(live), "once", "append").count() == 2
    again = run_log.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    windows = run_log.drained(run_log.windowed_counts(again), "w").collect()
    assert [(r.run, r.n) for r in windows] == [("r", 3)]
