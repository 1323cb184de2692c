"""Appends by key that read the keys of few files (SNK2, JN1, T4).

Beside a table's files lies a small index, one entry for each file: the least and the greatest key, and a Bloom
filter in blocks of 512 bits, so that a key looks at one block of a file. A batch is held against the
index, and only the files that may have one of its keys are read; their keys decide. A file with no more
rows than the batch has keys is read without a test, since testing all keys would cost more: tests are
never more than the table's rows. A file that an interrupted append left without an entry is always read,
and gets its entry with the next append.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS, BITS = 1 << 12, 4  # of a file's filter, 64 bytes each; bits of a key in its block
INDEX = "_keys"  # names with an underscore are no part of a table


def _places(key: Column) -> tuple[Column, Column]:
    """The block of a key, and the places of its bits there."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(BLOCKS)).cast("int"), F.array(*(F.shiftrightunsigned(h, 14 + 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(BITS)))


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def index_files(spark: SparkSession, path: str, key: str) -> None:
    """Adds the entries of files that have none."""
    data, files = _there(spark, path), _there(spark, f"{path}/{INDEX}/files")
    if data is None:
        return
    known = {r["file"] for r in files.select("file").collect()} if files is not None else set()
    new = [f for f in data.inputFiles() if f.rsplit("/", 1)[-1] not in known]
    if not new:
        return
    keys = spark.read.option("basePath", path).parquet(*new).select(F.col(key).alias("key"), _name(F.col("_metadata.file_path")).alias("file"))
    block, bits = _places(F.col("key"))
    words = [F.expr("bit_or(" + " | ".join(f"CASE WHEN shiftright(bits[{i}], 6) = {w} THEN shiftleft(1L, bits[{i}] & 63) ELSE 0L END" for i in range(BITS)) + ")") for w in range(8)]
    placed = keys.where("key IS NOT NULL").select("file", block.alias("block"), bits.alias("bits"))
    placed.groupBy("file", "block").agg(F.array(*words).alias("words")).coalesce(4).write.mode("append").parquet(f"{path}/{INDEX}/blocks")
    # Last, since an entry here says that the filter is whole.
    keys.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).coalesce(1).write.mode("append").parquet(f"{path}/{INDEX}/files")


def files_with(keys: DataFrame, path: str, key: str) -> list[str]:
    """The files of a table that may have one of the keys."""
    spark = keys.sparkSession
    data, files, blocks = _there(spark, path), _there(spark, f"{path}/{INDEX}/files"), _there(spark, f"{path}/{INDEX}/blocks")
    if data is None:
        return []
    every = {f.rsplit("/", 1)[-1]: f for f in data.inputFiles()}
    if files is None or blocks is None:
        return list(every.values())
    asked = keys.select(F.col(key).alias("key")).where("key IS NOT NULL")
    n, low, high = asked.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    entries = files.select("file", "n", ((F.col("lo") <= F.lit(high)) & (F.col("hi") >= F.lit(low))).alias("near")).collect() if n else files.select("file", "n", F.lit(False).alias("near")).collect()
    known = {r["file"] for r in entries}
    hit = {r["file"] for r in entries if r["near"] and r["n"] <= n}
    if any(r["near"] and r["n"] > n for r in entries):
        block, bits = _places(F.col("key"))
        placed = asked.distinct().select("key", block.alias("block"), bits.alias("bits"))
        large = files.select("file", "lo", "hi").where((F.col("n") > n) & (F.col("lo") <= F.lit(high)) & (F.col("hi") >= F.lit(low)))
        held = F.expr("forall(bits, b -> shiftright(get(words, shiftright(b, 6)), b & 63) & 1L = 1L)")
        tested = blocks.join(large, "file").join(placed, "block").where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")) & held)
        hit |= {r["file"] for r in tested.select("file").distinct().collect()}
    return [f for name, f in every.items() if name in hit or name not in known]


def append_keyed(new: DataFrame, path: str, key: str = "id", once: bool = True) -> None:
    """Adds the rows whose key isn't there; repeats within ``new`` and null keys stay. What is there is not written again.

    A batch given again after a failure adds nothing: what the failed append had written is read as a file without
    an entry. ``new`` is made once and stored before its keys are looked at; without ``once``, for rows that come out alike
    each time, nothing is stored first: the keys are made alone, then the rows.
    """
    from attestra.sources.tables import materialised

    spark = new.sparkSession
    if once and _there(spark, path) is not None:
        new = materialised(new)
    files = files_with(new, path, key)
    if files:
        seen = spark.read.option("basePath", path).parquet(*files).select(key).where(F.col(key).isNotNull())
        new = new.join(seen, key, "left_anti")
    new.write.mode("append").parquet(path)
    index_files(spark, path, key)
