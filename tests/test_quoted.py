"""CSV with line breaks inside quotes, by ranges, against Spark's reader of whole files."""

from __future__ import annotations

import random

import pytest

from attestra.sources import quoted, tables


def written(path, rows, mark="", end="\n"):
    cell = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') or x == "" else x
    path.write_bytes((mark + end.join(",".join(map(cell, r)) for r in rows) + end).encode())


@pytest.fixture
def small_ranges(spark):
    for name, value in (("spark.sql.files.maxPartitionBytes", "2000"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(name, value)
    yield
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def made(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["a", "é", " ", ",", '"', '""', "\n", "x\ny", "7", "|"]) for _ in range(r.randrange(12)))
    rows = [["id", "text", "more"]]
    for i in range(400):
        rows.append([str(i), r.choice([None, "", text(), text(), "plain"]), r.choice(["z", "5\" pipe".replace('"', "'"), text()])])
    rows[200][1] = "long\n" * 1200  # several ranges inside one field
    rows[300][1] = 'only "" quotes\n' * 300
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_file_by_many_tasks(spark, tmp_path, small_ranges, seed):
    written(tmp_path / "seed.csv", made(seed), "﻿" if seed == 2 else "")
    found = quoted.read_quoted(spark, str(tmp_path / "seed.csv"))
    want = spark.read.csv(str(tmp_path / "seed.csv"), header=True, multiLine=True, **quoted.OPTIONS)
    want = want.withColumnsRenamed({c: c.lstrip("﻿") for c in want.columns})
    assert found.columns == want.columns == ["id", "text", "more"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "seed.csv")).rdd.getNumPartitions() >= 8


def test_several_files_blank_lines_and_other_line_ends(spark, tmp_path, small_ranges):
    (tmp_path / "in").mkdir()
    written(tmp_path / "in/a.csv", made(4))
    written(tmp_path / "in/b.csv", [["id", "text", "more"], ["b1", "two\r\nlines", "x"], ["b2", None, "y"]], end="\r\n")
    (tmp_path / "in/c.csv").write_text('id,text,more\n\n"c1",un"quoted,"a ""b"""\n\n\nc2,,\n')
    found = {r.id: (r.text, r.more) for r in quoted.read_quoted(spark, str(tmp_path / "in")).collect()}
    assert len(found) == 404
    assert found["b1"] == ("two\r\nlines", "x")
    assert found["b2"] == (None, "y")
    assert found["c1"] == ('un"quoted', 'a "b"')
    assert found["c2"] == (None, None)


def test_states_of_lines():
    assert not quoted.inside_after('a,"b",c', False)
    assert quoted.inside_after('a,"b', False)
    assert not quoted.inside_after('b",c', True)
    assert quoted.inside_after('b"" c', True)
    assert quoted.inside_after('b",c,"', True)
    assert not quoted.inside_after('5" pipe,x', False)
    assert not quoted.inside_after('"",x', False)


def test_seeds_of_a_header_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,pcpl_inn\n")
    assert tables.read_dataset(spark, str(tmp_path / "h.csv"), "id long, pcpl_inn string").collect() == []
    (tmp_path / "e.csv").write_text("")
    assert tables.read_dataset(spark, str(tmp_path / "e.csv"), "id long, pcpl_inn string").collect() == []
