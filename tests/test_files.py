"""The file source and the artifact sink."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestra.sources import files, tables


@pytest.fixture
def root(tmp_path):
    for folder, name, size in (("11", "11_1.pdf", 5), ("12", "12_1.pdf", 900), ("12", "b_c_2.pdf", 0), ("12", "note.txt", 3), ("13", "x.pdf", 70_000)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"x" * size)
    return str(tmp_path)


def test_files_are_read_as_they_are(spark, root):
    rows = tables.read_files(spark, root).collect()
    assert sorted((r.guarantee_id, r.file_key, r.stem, r.length, len(r.content), r.path) for r in rows) == [
        ("11", "11", "11_1", 5, 5, f"{root}/11/11_1.pdf"), ("12", "12", "12_1", 900, 900, f"{root}/12/12_1.pdf"), ("12", "b_c", "b_c_2", 0, 0, f"{root}/12/b_c_2.pdf"), ("13", "x", "x", 70_000, 70_000, f"{root}/13/x.pdf"),
    ]
    assert tables.read_files(spark, root, "*", content=False).columns == ["path", "guarantee_id", "file_key", "stem", "modificationTime", "length"]
    assert tables.read_files(spark, root, "*.none").count() == 0


def test_filters_reach_the_listing(spark, root):
    found = tables.read_files(spark, root, "*").where((F.col("guarantee_id") == "12") & F.col("stem").startswith("b") & (F.col("length") < 10))
    assert [r.stem for r in found.collect()] == ["b_c_2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert all("guarantee_id" not in line and "stem" not in line for line in filters)
    assert any("length" in line for line in filters)
    reader = files.FileReader({"path": root}, spark.read.format("document_files").load(root).schema)
    left = list(reader.pushFilters([files.In(("guarantee_id",), ("11", "99", "..")), files.EqualTo(("length",), 5)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    assert [p.paths for p in reader.partitions()] == [[f"{root}/11/11_1.pdf"]]


def test_files_of_ids(spark, root, monkeypatch):
    ids = spark.createDataFrame([("12",), ("99",), (None,), ("12",)], "id string")
    for most in (1_000, 1):
        monkeypatch.setattr(tables, "PUSHED_IDS", most)
        assert sorted(r.stem for r in tables.read_files(spark, root, ids=ids).collect()) == ["12_1", "b_c_2"]


def test_partitions_are_of_near_equal_bytes():
    sizes = [90, 10, 10, 10, 50, 40, 30, 20, 20, 20]
    parts = files.packed(sizes, 3)
    sums = sorted(sum(sizes[i] for i in p) for p in parts)
    assert sorted(i for p in parts for i in p) == list(range(10))
    assert sums[-1] - sums[0] <= 10
    assert files.packed([], 4) == []
    assert files.packed([1], 4) == [[0]]


def written(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if files.STAGING not in d)


SCHEMA = "guarantee_id string, stem string, ocr_json string, ocr_md string, extraction_json string, meta_json string, content binary, other int"


def test_artifacts(spark, tmp_path):
    rows = [("g", f"s{i}", "{}" if i % 2 else None, "# Seite ä", None, "{}", bytearray(b"\x00pdf"), i) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    tables.write_artifacts(table, str(tmp_path / "out"), copy_source=True)
    want = sorted(f"g/s{i}/{n}" for i in range(20) for n in ("ocr.md", "meta.json", "source.pdf", *(["ocr.json"] if i % 2 else [])))
    assert [p for p in written(tmp_path / "out")] == want
    assert not os.path.exists(tmp_path / "out" / files.STAGING) or not os.listdir(tmp_path / "out" / files.STAGING)
    assert (tmp_path / "out/g/s3/ocr.md").read_text(encoding="utf-8") == "# Seite ä"
    tables.write_artifacts(table.where("stem = 's3'").withColumn("ocr_md", F.lit("new")), str(tmp_path / "out"))
    assert (tmp_path / "out/g/s3/ocr.md").read_text() == "new"
    assert written(tmp_path / "out") == want


@pytest.mark.parametrize("bad", [None, "..", "a/b", ""])
def test_a_failing_task_leaves_no_file(spark, tmp_path, bad):
    rows = [("g", f"s{i}", "{}", None, None, None, None, i) for i in range(30)] + [("g", bad, "{}", None, None, None, None, 99)]
    with pytest.raises(PySparkException):
        tables.write_artifacts(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "out"))
    assert written(tmp_path / "out") == []


def test_tasks_move_the_files(spark, tmp_path, monkeypatch):
    """The driver's commit touches no document's file, and of a file that several partitions wrote the last one's stays."""
    rows = [("g", f"s{i % 40}", str(i), None, None, None, None, i) for i in range(80)]
    table = spark.createDataFrame(rows, SCHEMA).repartitionByRange(8, "other")
    monkeypatch.setattr(files.os, "replace", lambda *_: pytest.fail("moved by the driver"))
    tables.write_artifacts(table, str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_text() for p in written(tmp_path / "out")} == {f"g/s{i}/ocr.json": str(i + 40) for i in range(40)}
    assert "files" not in files.Staged.__dataclass_fields__  # a message has no list of files
