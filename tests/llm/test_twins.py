import os

import pytest

from tallyloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    frame = queries.QUERIES[name](spark, DATA)
    result = db.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in frame.columns]
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
