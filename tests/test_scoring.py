from datetime import datetime

from tallyloom.operators import balance, dedupe, joins, judging, roadmap, scoring


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def replies(spark, data):
    return spark.createDataFrame([(i, "c", run, q, letter, datetime(2025, 1, 1, 0, i)) for i, (run, q, letter) in enumerate(data)], "pred_id bigint, corpus string, run string, question_number int, option string, answered_at timestamp")


def key(spark, data):
    return spark.createDataFrame([("c", q, letter, datetime(2025, 1, 1, 0, i)) for i, (q, letter) in enumerate(data)], "corpus string, question_number int, answer string, keyed_at timestamp")


def test_overlap_accuracy(spark):
    gold = scoring.gold_key(key(spark, [(1, "A"), (2, "b "), (3, "?"), (2, "C"), (4, None)]))
    assert rows(gold) == [("c", 1, "A"), ("c", 2, "C")]
    letters = scoring.run_letters(replies(spark, [("r", 1, "B"), ("r", 1, "a"), ("r", 2, "E"), ("r", 3, "A"), ("s", 2, "C"), ("s", 1, None)]), "option")
    assert rows(scoring.run_accuracy(letters, gold)) == [("c", "r", 1, 1, 0, 100.0), ("c", "s", 1, 1, 0, 100.0)]


def test_dense_table_and_extremes(spark):
    gold = scoring.gold_key(key(spark, [(i, "A") for i in range(1, 7)]))
    letters = scoring.run_letters(replies(spark, [("r", i, "A" if i % 2 else "B") for i in range(1, 7)]), "option")
    buckets = spark.createDataFrame([("c", i, (i - 1) // 2 + 1) for i in range(1, 7)], "corpus string, question_number int, bucket int")
    long = scoring.dense(scoring.bucket_accuracy(letters, gold, buckets), letters)
    assert long.count() == 8 and long.where("accuracy is null and n = 0").count() == 5
    assert rows(scoring.best_and_worst(long)) == [("c", "r", 1, 0.5, 1, 0.5)]
    assert rows(scoring.mean_rates(long, ["run"])) == [("r", 0.5, 3)]


def test_null_is_wrong_for_labelled_accuracy(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "id string, correct_index int")
    predicted = spark.createDataFrame([("r", "a", 0), ("r", "b", None), ("r", "c", 2)], "run string, id string, pred_index int")
    assert rows(scoring.labelled_accuracy(items, predicted, labels)) == [("r", 2, 1, 0.5)]
    assert rows(scoring.constant_baseline(items, labels)) == [("constant", 2, 1, 0.5)]


def test_judging_counts_blanks(spark):
    judged = spark.createDataFrame([("r", True, 3), ("r", False, None), ("r", False, 0)], "run string, is_correct boolean, alignment_score int")
    s = judging.summary(judged).first()
    assert (s.n_scored, s.accuracy, s.avg_alignment_score, s.pct_score_0, s.pct_score_3) == (3, 0.3333, 1.0, 0.3333, 0.3333)
    m = judging.conditional_means(judged).first()
    assert (m.mean_when_correct, m.mean_alignment) == (3.0, 1.5)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (200, 200)], "a int, b int")
    assert dict(rows(dedupe.components(edges))) == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}
    groups = spark.createDataFrame([([3, 1],), ([3, 5],), ([9],)], "members array<int>")
    known = spark.createDataFrame([(i,) for i in range(10)], "number int")
    assert rows(dedupe.merged_drops(groups, known, known.where("number = 5"))) == [(3,)]


def test_dedupe_keeps_empty_keys(spark):
    items = spark.createDataFrame([(3, "A b"), (1, "a B!"), (2, ""), (4, "?"), (5, None)], "n int, stem string")
    assert [r.n for r in dedupe.deduped(items, "stem", "n").sort("n").collect()] == [1, 2, 4, 5]
    accepted = spark.createDataFrame([(9, "a-b")], "n int, stem string")
    assert [r.n for r in dedupe.against_accepted(items, accepted, "stem", "n").sort("n").collect()] == [2, 4, 5]


def test_keep_list_and_plans(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([([9, 2, 2, 50],)], "k array<int>")
    assert frame.select(balance.keep_list(F.col("k"), 10, 5)).first()[0] == [1, 2, 3, 4, 9]
    assigned = spark.createDataFrame([(1,)] * 3 + [(8,)], "bucket int")
    plan = {r.bucket: (r.have, r.keep, r.generate) for r in balance.deficit_plan(assigned, 2).collect()}
    assert plan[1] == (3, 2, 0) and plan[8] == (1, 1, 1) and plan[2] == (0, 0, 2)


def test_joins(spark):
    import pytest

    base = spark.createDataFrame([(1, "A"), (2, "B")], "n int, gold string")
    over = spark.createDataFrame([(2, "D")], "n int, gold string")
    assert rows(joins.overridden(base, over, ["n"], "gold")) == [(1, "A"), (2, "D")]
    assert rows(joins.strict(over.select("n"), base, ["n"], "gold")) == [(2, "B")]
    with pytest.raises(Exception, match="no partner for 2"):
        joins.strict(base.select("n"), base.where("n = 1"), ["n"], "gold").collect()


def test_votes_and_chunks(spark):
    from pyspark.sql import functions as F

    votes = spark.createDataFrame([(1, "B"), (1, "A"), (2, "C"), (2, "C"), (2, "A")], "q int, letter string")
    assert rows(roadmap.majority(votes, ["q"], "letter")) == [(1, "A", 1, 2), (2, "C", 2, 3)]
    frame = spark.range(1).select(F.explode(roadmap.chunks(F.sequence(F.lit(1), F.lit(10)), 4, 1)).alias("c"))
    assert [r.c.words for r in frame.collect()] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]
