"""Appends by key that read few files."""

from __future__ import annotations

import os

import pytest

from attestra.sources import keyed


def batch(spark, ids, mark):
    return spark.createDataFrame([(i, mark) for i in ids], "id long, mark string").coalesce(1)


def read(spark, path):
    return sorted(((r.id if r.id is not None else -1), r.mark) for r in spark.read.parquet(path).collect())


def test_appends_read_the_files_that_may_have_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        keyed.append_keyed(batch(spark, range(1000 * k, 1000 * k + 500), f"b{k}"), path)
    assert len(keyed.files_with(batch(spark, [1003, 700], ""), path, "id")) == 1  # 700 is between the files' ranges
    assert keyed.files_with(batch(spark, [None], ""), path, "id") == []
    assert len(keyed.files_with(batch(spark, [2, 3499], ""), path, "id")) == 2
    before = read(spark, path)
    keyed.append_keyed(batch(spark, [1003, 1003, 9000, 9000, None], "new"), path)
    assert read(spark, path) == sorted([*before, (9000, "new"), (9000, "new"), (-1, "new")])
    keyed.append_keyed(batch(spark, [9000, 1, 3001], "again"), path)
    assert read(spark, path) == sorted([*before, (9000, "new"), (9000, "new"), (-1, "new")])


def test_keys_between_others_are_told_apart_by_the_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.append_keyed(batch(spark, range(0, 2000, 2), "even"), path)
    keyed.append_keyed(batch(spark, range(1, 2000, 4), "odd"), path)
    read_for = [len(keyed.files_with(batch(spark, [i], ""), path, "id")) for i in range(3, 403, 40)]  # 3, 7 ... are in neither
    assert sum(read_for) <= 2


def test_a_false_positive_is_decided_by_the_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCKS", 1)
    path = str(tmp_path / "t")
    keyed.append_keyed(batch(spark, range(0, 4000, 2), "even"), path)
    assert len(keyed.files_with(batch(spark, [1001], ""), path, "id")) == 1
    keyed.append_keyed(batch(spark, [1001, 1002], "new"), path)
    assert (1001, "new") in read(spark, path)
    assert (1002, "new") not in read(spark, path)


@pytest.mark.parametrize("lost", ["files", "all"])
def test_a_batch_repeated_after_a_failure_adds_nothing(spark, tmp_path, monkeypatch, lost):
    path = str(tmp_path / "t")
    keyed.append_keyed(batch(spark, range(100), "one"), path)
    if lost == "all":  # the index was not reached
        with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
            m.setattr(keyed, "index_files", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            keyed.append_keyed(batch(spark, range(50, 150), "two"), path)
    else:  # the filter was written, its entry not
        keyed.append_keyed(batch(spark, range(50, 150), "two"), path)
        folder = f"{path}/_keys/files"
        newest = max((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
        os.remove(f"{folder}/{newest}")
    keyed.append_keyed(batch(spark, range(50, 150), "two"), path)
    assert read(spark, path) == sorted([(i, "one") for i in range(100)] + [(i, "two") for i in range(100, 150)])


def test_keys_of_text(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id string, n int")
    keyed.append_keyed(rows("a", "b", "é"), path)
    keyed.append_keyed(rows("b", "c"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "é"]


def test_files_no_larger_than_the_batch_are_read_without_a_test_of_each_key(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(0, 4000, 2, 4).write.parquet(path)
    keyed.index_files(spark, path, "id")
    monkeypatch.setattr(keyed, "_places", lambda key: (_ for _ in ()).throw(AssertionError("tested")))
    assert len(keyed.files_with(spark.range(900, 1600), path, "id")) == 2  # 500 rows a file; two of the four files hold no key of this range
    with pytest.raises(AssertionError, match="tested"):
        keyed.files_with(spark.range(1000, 1100), path, "id")


def test_rows_that_come_out_alike_are_not_stored_first(spark, tmp_path, monkeypatch):
    from attestra.sources import tables

    path = str(tmp_path / "t")
    keyed.append_keyed(batch(spark, range(150), "one"), path)
    monkeypatch.setattr(tables, "materialised", lambda df: (_ for _ in ()).throw(AssertionError("stored")))
    keyed.append_keyed(batch(spark, range(100, 200), "two"), path, once=False)
    assert read(spark, path) == sorted([(i, "one") for i in range(150)] + [(i, "two") for i in range(150, 200)])
