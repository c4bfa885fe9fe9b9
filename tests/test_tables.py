"""Atomic tables: changes, versions, writers that meet."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_and_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"a{i}") for i in range(20)] + [(None, "null")], "k long, v string")
    own = tables.Table.create(first, root, ["k"], 4)
    with pytest.raises(FileExistsError):
        tables.Table.create(first, root, ["k"])
    delta = spark.createDataFrame([(3, "b3", 1), (3, "c3", 2), (99, "new", 1), (None, "again", 1)], "k long, v string, at long")
    assert own.upsert(delta, "at") == 2
    want = {i: f"a{i}" for i in range(20)} | {3: "c3", 99: "new", None: "again"}
    assert dict(rows(own.read())) == want
    assert own.update(spark.createDataFrame([(5,), (5,), (1000,), (None,)], "k long"), v=F.concat("v", F.lit("!"))) == 3
    want |= {5: "a5!", None: "again!"}
    assert dict(rows(own.read())) == want
    assert own.delete(spark.createDataFrame([(0,), (None,), (1000,)], "k long")) == 4
    del want[0], want[None]
    assert dict(rows(own.read())) == want and len(rows(own.read(1))) == 21 and own.versions() == [1, 2, 3, 4]
    assert own.delete(spark.createDataFrame([], "k long")) == 4  # nothing to do: no version
    old = own.read(3)
    own.vacuum(keep=2)
    assert own.versions() == [3, 4] and dict(rows(own.read())) == want and len(rows(old)) == 22
    with pytest.raises(FileNotFoundError):
        tables.Table(spark, str(tmp_path / "none")).read()


def test_only_touched_buckets_are_rewritten_and_replaced(spark, tmp_path):
    df = spark.createDataFrame([(i // 3, i) for i in range(60)], "d long, c long")
    own = tables.Table.create(df, str(tmp_path), ["d"], 16)
    before = own.manifest()["folders"]
    own.replace(spark.createDataFrame([(4, 1000), (77, 1)], "d long, c long"), "d")
    after = own.manifest()["folders"]
    assert sum(before.get(b) != f for b, f in after.items()) <= 2
    assert rows(own.read()) == sorted([(i // 3, i) for i in range(60) if i // 3 != 4] + [(4, 1000), (77, 1)], key=repr)
    with pytest.raises(ValueError):
        own.replace(df, "c")


def test_a_second_writer_fails_and_readers_see_whole_versions(spark, tmp_path):
    df = spark.createDataFrame([(i, 0) for i in range(10)], "k long, v long")
    one = tables.Table.create(df, str(tmp_path), ["k"], 2)
    two = tables.Table(spark, str(tmp_path))
    reading = two.read()
    stale = two.manifest()
    one.upsert(df.withColumn("v", F.lit(1).cast("long")))
    assert {r.v for r in reading.collect()} == {0}  # what was read stays as it was
    two.manifest = lambda version=None: stale  # a writer that started before
    with pytest.raises(tables.ConflictError):
        two.upsert(df.withColumn("v", F.lit(2).cast("long")))
    assert {r.v for r in one.read().collect()} == {1}


def test_empty_table(spark, tmp_path):
    own = tables.Table.create(spark.createDataFrame([], "k long, v string"), str(tmp_path), ["k"])
    assert own.read().count() == 0 and own.read().columns == ["k", "v"]
    own.upsert(spark.createDataFrame([(1, "x")], "k long, v string"))
    own.delete(spark.createDataFrame([(1,)], "k long"))
    assert own.read().count() == 0
