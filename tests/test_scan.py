"""Scans over ranges against windows."""

from __future__ import annotations

import collections
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import scan


def same(rows, got):
    w = Window.partitionBy("job").orderBy("at", "id")
    want = rows.withColumns({"version": F.row_number().over(w).cast("long"), "previous_payload": F.lag("payload").over(w)})
    key = lambda r: (r.id, r.job or "", r.version, r.previous_payload or "", r.payload or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*got.columns).collect()))


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_numbered(spark, batch):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "a", "b", None]) if i % 2 else f"j{i}", r.randrange(40), i, None if i % 5 == 0 else f"p{i}", i) for i in range(900)]
    table = spark.createDataFrame(rows, "job string, at long, id long, payload string, version_ int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        same(table, scan.numbered(table, "job", ("at", "id"), "payload"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert scan.numbered(table.where("false"), "job", ("at", "id"), "payload").collect() == []


def test_a_hot_key_is_cut_like_any_other(spark):
    """One job holds a third of all events: no range has over twice the median range's rows."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 5000)).alias("job"), (F.col("id") * 7919 % 60_000).alias("at"), "id", F.col("id").cast("string").alias("payload"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        sizes = [r["count"] for r in scan.range_scan(rows, "job", ("at", "id"), "payload").groupBy("_scan_p").count().collect()]
        assert len(sizes) == 12
        assert max(sizes) <= 2 * statistics.median(sizes)
        same(rows, scan.numbered(rows, "job", ("at", "id"), "payload"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_children_pages(spark):
    parents = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k int, name string")
    children = spark.createDataFrame([(i % 4 if i % 9 else 1, 100 - i, i) for i in range(90)] + [(None, 1, 1)], "k int, at int, id int")
    got = collections.defaultdict(list)
    for r in scan.children_pages(parents, "k", children, ("at", "id"), "children", 7).orderBy("k", "page").collect():
        assert r.name == f"n{r.k}"
        assert r.page == len(got[r.k]) // 7
        assert len(r.children) <= 7
        got[r.k] += [(c["at"], c["id"]) for c in r.children]
    want = collections.defaultdict(list)
    for i in range(90):
        want[i % 4 if i % 9 else 1].append((100 - i, i))
    assert got == {**{k: sorted(v) for k, v in want.items()}, 4: []}
