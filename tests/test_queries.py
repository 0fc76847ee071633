import os

import pytest

import __spark_entry__ as entry
from tallyloom.operators import roadmap

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["corpus", "run", "bucket", "bucket_name", "n", "correct", "accuracy"] and got.count() > 0


def test_every_document_counts(spark, tmp_path):
    said = [(1, "transcript", "Uh, the plain one ."), (2, "transcript", "um the café’s\tpolicy ,\r\nsigned"), (3, "page", "uh"), (4, "transcript", None), (5, "transcript", "er größer  multiplechoice,now")]
    spark.createDataFrame(said, "doc_id bigint, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.prose for r in entry.queries()["prose_clean"](spark, str(tmp_path)).collect()}
    assert got == {3: "", 1: ", the plain one.", 2: "the café’s policy, signed", 5: "größer multiple-choice, now"}


def test_nearest_keeps_the_smallest_ids_of_ties_and_any_number_of_queries(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60, 0, -1)] + [(100 + i, [0.0, 1.0]) for i in range(5)]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    got = {}
    for r in roadmap.nearest(base.where("vec_id >= 56"), base, 3, most_queries=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: [(1, 1.0), (2, 1.0), (3, 1.0)] if i <= 60 else [(j, 1.0) for j in range(100, 105) if j != i][:3] for i in [*range(56, 61), *range(100, 105)]}


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p") or not n[1].isdigit()) + ["p4_found", "p4_statistics", "p5_found", "p5_items", "p5_keys", "p5_report"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in columns) for r in frame.collect()), key=repr) == wanted
