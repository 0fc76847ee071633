import csv
import io
import random
import re

from tallyloom.operators import drift, rejects

RAW = "raw_id bigint, feed string, file_name string, raw_text string, failure string"


def verdicts(spark, records):
    frame = spark.createDataFrame([(i, feed, "f", text, "x") for i, (feed, text, _) in enumerate(records)], RAW)
    return frame, {r.raw_id: r.failure for r in rejects.failures(frame).collect()}


def test_reasons(spark):
    records = [
        ("mcq", "1,stem,a,b,c,d", None), ("mcq", ' 7 ,"stem, with ""quotes""\nand line",a,b,c,d', None), ("mcq", '1,stem,a,b"x,c,d', "quoting"), ("mcq", '1,"stem,a,b,c,d', "quoting"),
        ("mcq", '1,"stem" x,a,b,c,d', "quoting"), ("mcq", ' "1",stem,a,b,c,d', "quoting"), ("mcq", "1,stem,a,b,c", "column_count"), ("mcq", "1,stem,a,b,c,d,e", "column_count"), ("mcq", "", "column_count"),
        ("mcq", None, "column_count"), ("mcq", "0,stem,a,b,c,d", "bad_value"), ("mcq", "007,stem,a,b,c,d", None), ("mcq", "+7,stem,a,b,c,d", "bad_value"), ("mcq", "7,stem,a,\t,c,d", "bad_value"),
        ("mcq", '7,stem,a,"\xa0",c,d', "bad_value"), ("mcq", "١٢,stem,a,b,c,d", "bad_value"), ("answers", "7 A", None), ("answers", "7)\tb # note \"x\"", None), ("answers", '"7" "C"', None), ("answers", "7 ?", None),
        ("answers", "# 7 A", None), ("answers", "  \t", None), ("answers", None, None), ("answers", '7 "A', "quoting"), ("answers", '"7""  B', "quoting"), ("answers", "7", "column_count"), ("answers", "7 A B", "column_count"),
        ("answers", "7 E", "bad_value"), ("answers", "0. A", "bad_value"), ("answers", "7.. A", "bad_value"), ("answers", "Q7 A", "bad_value"), ("other", "x", None),
        ("mcq", "9," + "x" * 300_000 + ',"' + '""' * 50_000 + 'z",b,c,d', None),
    ]
    frame, got = verdicts(spark, records)
    assert got == {i: reason for i, (_, _, reason) in enumerate(records) if reason}
    items, keys = rejects.clean(frame)
    found = {r.raw_id: r for r in items.collect()}
    assert found[1].stem == 'stem, with "quotes"\nand line' and found[1].question_number == 7 and found[1].choices["D"] == "d"
    assert {(r.question_number, r.gold) for r in keys.collect()} == {(7, "A"), (7, "B"), (7, "C"), (7, None)}
    assert sum(r.n_rows for r in rejects.report(frame).collect()) == len(got)


def test_quoting_agrees_with_a_state_machine(spark):
    def brute(text):
        fields, at, n = 0, 0, len(text)
        while True:
            fields += 1
            if at < n and text[at] == '"':
                at += 1
                while True:
                    if at >= n:
                        return None
                    if text[at] == '"':
                        if text[at + 1 : at + 2] == '"':
                            at += 2
                            continue
                        at += 1
                        break
                    at += 1
                if at < n and text[at] != ",":
                    return None
            else:
                while at < n and text[at] != ",":
                    if text[at] == '"':
                        return None
                    at += 1
            if at >= n:
                return fields
            at += 1

    rng = random.Random(3)
    texts = ["".join(rng.choice('a",\n ') for _ in range(rng.randint(0, 12))) for _ in range(500)]
    _, got = verdicts(spark, [("mcq", t, None) for t in texts])
    for i, t in enumerate(texts):
        n = brute(t)
        assert got[i] == ("quoting" if n is None else "column_count" if n != 6 else got[i]), t


def test_empty(spark):
    frame = spark.createDataFrame([], RAW)
    assert rejects.failures(frame).count() == rejects.clean(frame)[0].count() == 0


FILES = "file_id bigint, feed_id bigint, run string, corpus string, written_at timestamp, place int"
LINES = "file_id bigint, line_no int, line string, old_name string"


def changes(spark, contents):
    from datetime import datetime

    files = spark.createDataFrame([(i, 1, "r", "c", datetime(2025, 1, 1 + i), 0) for i in range(len(contents))], FILES)
    lines = spark.createDataFrame([(i, n, line, "") for i, rows in enumerate(contents) for n, line in enumerate(rows)], LINES)
    return files, lines, sorted(tuple(r) for r in drift.changes(files, lines).collect())


def test_changes(spark):
    contents = [
        ["question_number,answer,reason", "1,A,x", "2,B,"],
        ["﻿QUESTION_NUMBER, Answer ,latency_s", '1,A,"1.5"', "2,B,2"],
        ['"question_number","latency_s","answer"', '"1","1","A"'],
        ["qnum,latency_s,answer,hit", "Q1,1,A,true", "Q2,2,B,False"],
        ["qnum,latency_s,answer,hit", "Q1,,A,0"],
        ["qnum,latency_s,answer,hit", "Q1,1 s,A,yes"],
    ]
    files, lines, got = changes(spark, contents)
    assert got == [
        (1, "renamed", "reason", "latency_s"), (1, "retyped", "reason", "latency_s"), (2, "retyped", "latency_s", "latency_s"),
        (3, "added", "", "hit"), (3, "renamed", "question_number", "qnum"), (3, "retyped", "question_number", "qnum"),
        (4, "retyped", "hit", "hit"), (5, "retyped", "hit", "hit"),
    ]
    one = {(r.file_id, r.line_no): r for r in drift.unified(files, lines).collect()}
    assert one[0, 1].question_number == 1 and one[3, 1].question_number == 1 and one[3, 2].others == {"hit": "False"}
    assert one[5, 1].latency_s == 1.0 and one[4, 1].latency_s is None and not one[4, 1].failed_casts
    assert {r.n_values for r in drift.statistics(lines).where("file_id = 0").collect()} == {2}


def test_synonyms_in_one_file_keep_both_values(spark):
    contents = [["question_number,answer,option", "7,A,D", "8,A,", "x9y,B,C", "10,,"], ["option,choice,latency_s", "A,B,12 sec", "C,,soon"]]
    files, lines, _ = changes(spark, contents)
    got = {(r.file_id, r.line_no): (r.question_number, r.choice, r.latency_s, r.others, r.failed_casts) for r in drift.unified(files, lines).collect()}
    assert got == {
        (0, 1): (7, "D", None, {"answer": "A"}, []), (0, 2): (8, "A", None, {}, []), (0, 3): (9, "C", None, {"answer": "B"}, []), (0, 4): (10, None, None, {}, []),
        (1, 1): (None, "A", 12.0, {"choice": "B"}, []), (1, 2): (None, "C", None, {"latency_s": "soon"}, ["latency_s"]),
    }


def test_odd_files(spark):
    contents = [["a,a,b", "1,2,3"], [""], ["a,b", "1,2,3,4", "5"], ["c"]]
    _, lines, got = changes(spark, contents)
    assert ("renamed" in {c for _, c, _, _ in got}) and len(got) >= 3
    files, lines, got = changes(spark, [])
    assert got == [] and drift.unified(files, lines).count() == 0


def test_fields_agree_with_the_csv_module(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [["".join(rng.choice('ab", ') for _ in range(rng.randint(0, 5))).strip() for _ in range(rng.randint(1, 4))] for _ in range(200)]
    written = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        written.append(out.getvalue())
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(written)], "i int, line string")
    got = {r.i: r.f for r in frame.select("i", drift.fields(F.col("line")).alias("f")).collect()}
    assert all(got[i] == row for i, row in enumerate(rows))
    assert re.fullmatch(r"[a-z_]+", "file_id")
