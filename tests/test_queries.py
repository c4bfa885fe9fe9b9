"""Every registered query of the engine against its DuckDB equivalent on the smallest tables."""

import datetime

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert rows
        return
    answer = duck.execute(catalog.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert rows == want


def test_vectors_of_other_and_null_labels_are_found(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 2), (3, [1.0, 0.2], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES["vector_topk_all"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [2, 3, 1]


def test_job_folds_collect_no_lists(spark, sf):
    plan = catalog.QUERIES["job_retry_fold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
