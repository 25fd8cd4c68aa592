"""Keyed tables: what a change rewrites, what readers see, and who is refused."""

import pytest
from pyspark.sql import functions as F

from loomstone.sources.snapshots import SnapshotTable
from loomstone.sources.store import Conflict, Keyed, Store

T = Keyed("t", "id long, v string", "id", buckets=8)
U = Keyed("u", "id long, v string", "id % 3", buckets=4, split="length(v)")


def folders(store, table):
    return store.manifest()["tables"][table.name]


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read(T).count() == 0
    rows = spark.range(100_000).select("id", F.lit("a").alias("v"))
    c = s.change()
    c.write(T, rows)
    assert s.version() == 0 and c.commit() == 1
    before = folders(s, T)
    assert set(before) == set(map(str, range(8)))
    c = s.change()
    touched = c.replace(T, spark.createDataFrame([(7, "b"), (7, "c")], "id long, v string"))
    assert len(touched) == 1 and c.read(T).count() == 100_001 and s.read(T).count() == 100_000
    c.commit()
    after = folders(s, T)
    assert {b for b in after if after[b] != before[b]} == {str(touched[0])}
    assert sorted(r["v"] for r in s.read(T).where("id = 7").collect()) == ["b", "c"] and s.read(T, buckets=touched).where("id = 7").count() == 2
    assert s.read(T, version=1).where("id = 7").first()["v"] == "a"
    c = s.change()
    assert c.replace(T, None, spark.createDataFrame([(7,), (-1,)], "k long")) and c.replace(T, None, spark.range(0)) == []
    c.commit()
    assert s.read(T).count() == 99_999


def test_several_tables_are_one_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    c = s.change()
    c.write(T, spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"))
    c.write(U, spark.createDataFrame([(1, "x"), (2, "yy"), (4, "zzz")], "id long, v string"))
    c.facts["n"] = 5
    c.commit()
    c = s.change()
    c.truncate(T)
    c.replace(U, spark.createDataFrame([(7, "new")], "id long, v string"))  # 1, 4 and 7 have one key
    assert s.read(T).count() == 2 and s.read(U).count() == 3
    assert c.commit() == 2 and s.read(T).count() == 0 and s.manifest()["facts"] == {"n": 5}
    assert sorted(map(tuple, s.read(U).collect())) == [(2, "yy", 2), (7, "new", 3)]
    plan = s.read(U).where("split = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    c = s.change()
    c.write(T, spark.createDataFrame([(9, "never")], "id long, v string"))
    with pytest.raises(Exception, match="boom|DIVIDE"):
        c.write(U, spark.range(3).select("id", F.expr("raise_error('boom')").cast("string").alias("v")))
    assert s.version() == 2 and s.read(T).count() == 0  # a change that fails leaves no trace


def test_second_writer_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(k, "x")], "id long, v string")
    one, two = s.change(), Store(spark, str(tmp_path / "s")).change()
    one.replace(T, row(1))
    two.replace(T, row(2))
    assert two.commit() == 1
    with pytest.raises(Conflict):
        one.commit()
    assert [r["id"] for r in s.read(T).collect()] == [2]
    again = s.change()
    again.replace(T, row(1))
    assert again.commit() == 2 and sorted(r["id"] for r in s.read(T).collect()) == [1, 2]
    t = SnapshotTable(spark, str(tmp_path / "t"), "id long, v string")
    late = t.store.change()
    late.write(t.table, row(3))
    t.write(row(4))
    with pytest.raises(Conflict):
        late.commit()
    assert [r["id"] for r in t.read().collect()] == [4]


def test_old_versions_expire(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for k in range(6):
        c = s.change()
        c.replace(T, spark.createDataFrame([(k % 2, str(k))], "id long, v string"))
        c.commit()
    assert s.expire(2) > 0 and s.versions() == [5, 6] and s.expire(2) == 0
    assert sorted(r["v"] for r in s.read(T).collect()) == ["4", "5"] and sorted(r["v"] for r in s.read(T, version=5).collect()) == ["3", "4"]
    assert s.change().base["version"] == 6
