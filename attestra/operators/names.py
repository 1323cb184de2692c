"""Unique names. In order, a name met before gets ``__k`` before its ending, k the first number that is free then.

The rule is sequential: a number is passed over if a file of that very name came earlier, and a file
that comes after its name was made is numbered itself. Told apart by names it is this: the
repeats of a name take 1, 2, 3 ... in order, and step over a number k whose own name was given
before its turn, that is, if k less the repeats before that file is more than the numbers
stepped over so far. So only names that numbering could make of another given name need a
look, one row for each such pair; the rounds follow names that are made of made names. Files of a name are
counted by ranges and never meet in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.scan import numbered
from attestra.sources.tables import materialised


def split(name: Column) -> tuple[Column, Column]:
    """Stem and ending."""
    pattern = r"(?s)^(.+?)(\.[^.]*)?$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def made(name: Column, k: Column) -> Column:
    stem, ending = split(name)
    return F.concat(stem, F.lit("__"), k.cast("string"), ending)


def _stepped_over(pairs: pd.DataFrame) -> pd.DataFrame:
    """Numbers of one name that its repeats step over, and names that they take from a later file. A row for each number that a file has as its name."""
    pairs = pairs.sort_values("k")
    passed, at, taken = 0, [], []
    for k, before, repeats in zip(pairs["k"], pairs["repeats_before"], pairs["repeats"], strict=True):
        over = k - before > passed
        at.append(k - passed if over else None)
        taken.append(not over and k - passed <= repeats)
        passed += over
    return pd.DataFrame({"parent": pairs["parent"], "child": pairs["child"], "at": pd.array(at, "Int64"), "taken": taken})


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with ``unique_name``, numbered in ``order`` (unique, not null).

    Rows with a null name keep a null one and take no number. An empty table gives an empty result. Other columns stay.
    """
    given = rows.where(F.col(name).isNotNull())
    none = rows.where(F.col(name).isNull()).withColumn("unique_name", F.col(name))
    seen = materialised(numbered(given, name, (order,), number="_seen"))
    names = materialised(seen.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")))
    stem, ending = split(F.col("name"))
    children = names.select(F.col("name").alias("child"), "first", F.concat(F.regexp_extract(stem, r"(?s)^(.+)__[1-9][0-9]*$", 1), ending).alias("name"), F.regexp_extract(stem, r"(?s)^.+__([1-9][0-9]*)$", 1).try_cast("long").alias("k"))
    pairs = children.where("k IS NOT NULL").join(names.select("name", "n"), "name").where(made(F.col("name"), F.col("k")) == F.col("child"))
    pairs = materialised(pairs.select(F.col("name").alias("parent"), "child", "k", "n", "first"))
    number, own = F.col("_seen") - 1, F.col(name)
    if not pairs.take(1):
        return seen.withColumn("unique_name", F.when(number == 0, own).otherwise(made(own, number))).select(*rows.columns, "unique_name").unionByName(none)
    # Files of a parent before the child's first one: both in one scan, less the children before.
    parents = materialised(pairs.select("parent").distinct())
    files = seen.join(parents, F.col(name) == F.col("parent"), "left_semi").select(own.alias("parent"), F.col(order).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("child"))
    probes = pairs.select("parent", F.col("first").alias("at"), F.lit(1).alias("kind"), "child")
    among = numbered(files.unionByName(probes), "parent", ("at", "kind", "child"), number="all").where("kind = 1")
    alone = numbered(probes, "parent", ("at", "child"), number="own").select("child", "own")  # a name has one parent
    before = among.join(alone, "child").select("child", (F.col("all") - F.col("own")).alias("files_before"))
    pairs = materialised(pairs.join(before, "child"))
    # Rounds from names that no other could make to what is made of them.
    below = pairs.select(F.col("child").alias("parent")).distinct()
    now = pairs.join(below, "parent", "left_anti").withColumn("lost", F.lit(False))
    found = None
    while True:
        lost = F.col("lost").cast("int")
        counts = now.select("parent", "child", "k", (F.col("n") - 1 + lost).alias("repeats"), (F.greatest(F.col("files_before") - 1 + lost, F.lit(0))).alias("repeats_before"))
        step = materialised(counts.groupBy("parent").applyInPandas(_stepped_over, "parent string, child string, at long, taken boolean"))
        if not step.take(1):
            break
        found = step if found is None else found.unionByName(step)
        now = pairs.join(step.select(F.col("child").alias("parent"), F.col("taken").alias("lost")), "parent")
    lost = found.where("taken").select(F.col("child").alias("_lost"))
    marked = seen.join(lost, own == F.col("_lost"), "left").withColumn("_j", number + F.when(F.col("_lost").isNull(), 0).otherwise(1)).drop("_lost")
    marked = materialised(marked)
    stepped = materialised(found.where("at IS NOT NULL").select(F.col("parent").alias("_parent"), "at"))
    few = stepped.select("_parent").distinct()
    plain = marked.join(few, own == F.col("_parent"), "left_anti").withColumn("_number", F.col("_j"))
    # A repeat's number is its place among the repeats and the numbers stepped over before it.
    moved = marked.join(few, own == F.col("_parent"), "left_semi")
    turns = moved.where("_j > 0").select(own.alias("_name"), F.col("_j").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    steps = stepped.select(F.col("_parent").alias("_name"), F.col("at").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(turns.schema["_row"].dataType).alias("_row"))
    placed = numbered(turns.unionByName(steps), "_name", ("_at", "_kind"), number="_number").where("_kind = 1").select("_row.*", "_number")
    kept = moved.where("_j = 0").withColumn("_number", F.lit(0).cast("long"))
    done = plain.select(*rows.columns, "_number").unionByName(kept.select(*rows.columns, "_number")).unionByName(placed)
    return done.select(*rows.columns, F.when(F.col("_number") == 0, own).otherwise(made(own, F.col("_number"))).alias("unique_name")).unionByName(none)
