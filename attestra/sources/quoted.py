"""CSV with line breaks inside quotes, read by byte ranges (SRC1, SRC13): one large file is many tasks.

Spark's text source cuts a file into ranges of whole lines. Whether a line begins inside a quoted
field depends on all lines before it, so every range is scanned for both answers; the ranges' ends,
a row for each, are then followed through each file and tell which answer was right. Records of one line,
nearly all, stay where they were read; only the lines of longer ones are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000
OPTIONS = {"quote": '"', "escape": '"'}


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field. A quote opens a field only at its begin; two quotes inside are one."""
    at, n = 0, len(line)
    while True:
        if inside:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] == '"':
                    at += 2
                    continue
                break
            inside = False
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if not at or at > n:
            return False


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in the range, and for both answers whether they begin and end inside quotes; the range's last line is marked by a row of its own."""
    range_, count, states = None, 0, (False, True)

    def out(file, block, place, value, before, after, ends):  # noqa: ANN001, ANN202
        bools = [pa.array([s[k] for s in side], pa.bool_()) for side in (before, after) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([file, block, pa.array(place, pa.int64()), value, *bools, pa.array([ends] * len(place), pa.bool_())], names=["file", "block", "n", "value", "b0", "b1", "a0", "a1", "ends"])

    def end():  # noqa: ANN202
        return out(pa.array([range_[0]]), pa.array([range_[1]], pa.int64()), [count], pa.array([None], pa.string()), [states], [states], True)

    for batch in batches:
        quoted = pc.match_substring(batch.column(0), '"').to_pylist()
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        at = 0
        while at < len(quoted):
            if range_ != (files[at], blocks[at]):
                if range_ is not None:
                    yield end()
                range_, count, states = (files[at], blocks[at]), 0, (False, True)
            stop = at
            while stop < len(quoted) and (files[stop], blocks[stop]) == range_:
                stop += 1
            before, after = [], []
            for i in range(at, stop):
                before.append(states)
                if quoted[i]:
                    line = batch.column(0)[i].as_py()
                    states = (inside_after(line, states[0]), inside_after(line, states[1]))
                after.append(states)
            part = batch.slice(at, stop - at)
            yield out(part.column(1), part.column(2), range(count, count + stop - at), part.column(0), before, after, False)
            count += stop - at
            at = stop
    if range_ is not None:
        yield end()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, record`` of every record of the files of a path, headers too; blank lines are none."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    scanned = lines.mapInArrow(_scanned, "file string, block long, n long, value string, b0 boolean, b1 boolean, a0 boolean, a1 boolean, ends boolean")
    ends = scanned.where("ends").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "a0", "a1"))).alias("ranges"))  # a row for each range
    follow = F.aggregate(
        "ranges",
        F.struct(F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("found"), F.lit(False).alias("inside")),
        lambda s, r: F.struct(F.array_append(s["found"], F.struct(r["block"].alias("block"), s["inside"].alias("inside"))).alias("found"), F.when(s["inside"], r["a1"]).otherwise(r["a0"]).alias("inside")),
    )
    starts = ends.select("file", F.explode(follow["found"]).alias("x")).select("file", "x.block", "x.inside")
    told = scanned.where("NOT ends").join(F.broadcast(starts), ["file", "block"])
    pick = lambda k: F.when(F.col("inside"), F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    told = told.select("file", "block", "n", "value", pick("b").alias("before"), pick("a").alias("after"))
    single = told.where("NOT before AND NOT after").select("file", "block", "n", F.col("value").alias("record"))
    pieces = told.where("before OR after")
    own = F.when(~F.col("before"), F.struct("block", "n"))
    pieces = pieces.withColumn("begin", F.last(own, ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("n")))
    last = pieces.groupBy("file", "block").agg(F.max("begin").alias("last"))  # a row for each range at most
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = pieces.join(F.broadcast(carried), ["file", "block"]).withColumn("begin", F.coalesce("begin", "carried"))
    whole = whole.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    multi = whole.select("file", "begin.block", "begin.n", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    found = single.unionByName(multi).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return found.where("record <> ''")


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """The columns of CSV files with a header, as texts. A byte order mark is dropped, quotes are doubled inside quotes; files have the columns of the first."""
    names = [c.lstrip("﻿") for c in spark.read.csv(path, header=True, multiLine=True, **OPTIONS).columns]
    rows = records(spark, path).where("block > 0 OR n > 0")
    kinds = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("record", kinds, OPTIONS).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))
