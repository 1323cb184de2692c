"""Database tables through the embedded database of Spark's jars."""

from __future__ import annotations

import pytest

from attestra.sources import tables


@pytest.fixture
def url(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_ranges_of_near_equal_rows_and_repeated_batches(spark, url):
    rows = [(i if i < 900 else 10**9 + i, f"n{i}", i / 2) for i in range(1000)] + [(None, "none", 0.0)]
    table = spark.createDataFrame(rows, "id long, name string, x double")
    tables.write_batch(table.where("id < 500"), url, "t", 1, types="name VARCHAR(20)")
    tables.write_batch(table.where("id >= 500 OR id IS NULL").limit(7), url, "t", 2)
    tables.write_batch(table.where("id >= 500 OR id IS NULL"), url, "t", 2)
    found = tables.read_table(spark, url, "t", "id", parts=5)
    assert sorted((r.id or -1, r.name, r.x) for r in found.collect()) == sorted((i or -1, n, x) for i, n, x in rows)
    assert [len(p) for p in found.rdd.glom().collect()] == pytest.approx([200] * 5, abs=2)
    some = found.where("x > 400 AND x < 410")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    assert "*GreaterThan(x,400.0)" in plan
    assert some.count() == 19
    assert tables.read_table(spark, url, "t", "id", parts=3, where='"x" < 10').count() == 21
    assert tables.read_table(spark, url, "t").count() == 1001
    assert tables.read_table(spark, url, "t", "id", where='"x" < -1').count() == 0


def test_a_shared_sqlite_file_serves_several_executors(spark, tmp_path):
    """The same as above; each task has a connection of its own, so no JVM owns the database."""
    url = f"sqlite:{tmp_path}/a b/db"
    rows = [(i if i < 900 else 10**9 + i, f"n{i}", i / 2) for i in range(1000)] + [(None, "none", 0.0)]
    table = spark.createDataFrame(rows, "id long, name string, x double")
    tables.write_batch(table.where("id < 500").repartition(4), url, "t", 1)
    tables.write_batch(table.where("id >= 500 OR id IS NULL").limit(7), url, "t", 2)
    tables.write_batch(table.where("id >= 500 OR id IS NULL"), url, "t", 2)
    found = tables.read_table(spark, url, "t", "id", parts=5)
    assert found.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("batch", "int")]
    assert sorted((r.id or -1, r.name, r.x) for r in found.collect()) == sorted((i or -1, n, x) for i, n, x in rows)
    assert [len(p) for p in found.rdd.glom().collect()] == pytest.approx([200] * 5, abs=2)
    assert found.where("x > 400 AND x < 410").count() == 19
    assert found.where("name = 'n7'").count() == 1
    assert tables.read_table(spark, url, "t", "id", parts=3, where='"x" < 10').count() == 21
    assert tables.read_table(spark, url, "t").count() == 1001
    assert tables.read_table(spark, url, "t", "id", where='"x" < -1').count() == 0
    with pytest.raises(Exception, match="NaN"):
        tables.write_batch(spark.sql("SELECT 1L AS id, 'a' AS name, double('NaN') AS x"), url, "t", 3)
    assert tables.read_table(spark, url, "t").count() == 1001
