"""Segmented scans over ranges (W3, JN5): rows of a key are numbered in order, and each gets the value before it,
though a key may span many tasks.

Rows are dealt by ranges of key and order, so that a hot key is cut like any other. Each range
is scanned alone; its last row then tells how many rows of its key it holds and the last value,
and these tails, a row for each range, are summed along the ranges and carried to where the key goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from attestra.sources.tables import materialised


def _differs(column: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls are equal."""
    equal = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(pc.is_null(column), pc.is_null(before)))
    return ~equal.to_numpy(zero_copy_only=False)


def range_scan(rows: DataFrame, key: str, order: tuple[str, ...], value: str | None = None) -> DataFrame:
    """``rows`` by ranges, written: within a range ``_scan_n`` numbers the rows of a key, ``_scan_before`` is the value before,
    ``_scan_open`` marks the key with which the range begins, ``_scan_tail`` its last row, ``_scan_p`` is the range."""
    names = rows.columns
    schema = rows.schema
    at, value_at = names.index(key), names.index(value) if value else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, last_key, last_value, count, open_ = None, None, None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            n, keys = batch.num_rows, batch.column(at)
            previous = pa.concat_arrays([last_key if last_key is not None else keys[:1], keys[: n - 1]])
            new = _differs(keys, previous)
            new[0] |= last_key is None
            starts = np.flatnonzero(new)
            began = np.zeros(n, np.int64)
            began[starts] = starts
            began = np.maximum.accumulate(began)
            number = np.arange(n) - began + 1
            goes_on = int(starts[0]) if len(starts) else n  # rows of the key of the batch before
            number[:goes_on] += count
            still = np.zeros(n, bool)
            runs = np.cumsum(new)
            if open_:
                still = runs <= (1 if last_key is None else 0)
                open_ = bool(still[-1])
            if value:
                values = batch.column(value_at)
                shifted = pa.concat_arrays([last_value if last_value is not None else values[:1], values[: n - 1]])
                before = pc.if_else(pa.array(new), pa.scalar(None, values.type), shifted)
                last_value = values[n - 1 :]
            else:
                before = pa.nulls(n, pa.int32())
            last_key, count = keys[n - 1 :], int(number[-1])
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.zeros(len(held[0]), bool))], names=out)
            held = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(number), before, pa.array(still)]
        if held is not None:
            tail = np.zeros(len(held[0]), bool)
            tail[-1] = True
            yield pa.RecordBatch.from_arrays([*held, pa.array(tail)], names=out)

    more = {"_scan_p": IntegerType(), "_scan_n": LongType(), "_scan_before": schema[value].dataType if value else IntegerType(), "_scan_open": BooleanType(), "_scan_tail": BooleanType()}
    made = StructType([*schema.fields, *(StructField(n, kind) for n, kind in more.items())])
    out = made.names
    return materialised(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(scan, made))


def numbered(rows: DataFrame, key: str, order: tuple[str, ...], value: str | None = None, number: str = "version", before: str = "previous_payload") -> DataFrame:
    """``rows`` with ``number``, from 1 within each key in order, and ``before``, the value of the row before (null for the first).

    Null keys are one key. ``order`` should order the rows of a key wholly; ties are numbered as they come. An empty table gives an empty result.
    """
    scanned = range_scan(rows, key, order, value)
    nothing = F.lit(None).cast(scanned.schema["_scan_before"].dataType)
    tails = scanned.where("_scan_tail").select(F.col(key).alias("k"), F.col("_scan_p").alias("p"), F.lit(1).alias("kind"), F.col("_scan_n").alias("n"), F.struct((F.col(value) if value else nothing).alias("v")).alias("last"))
    heads = scanned.where("_scan_open AND _scan_n = 1").select(F.col(key).alias("k"), F.col("_scan_p").alias("p"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(tails.schema["last"].dataType).alias("last"))
    along = Window.partitionBy("k").orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.unionByName(heads).select("p", "kind", F.sum("n").over(along).alias("_scan_sum"), F.last("last", ignorenulls=True).over(along).alias("_scan_last"))
    carried = carried.where("kind = 0 AND _scan_sum > 0").select(F.col("p").alias("_scan_p"), "_scan_sum", "_scan_last")  # at most a row for each range
    joined = scanned.join(F.broadcast(carried), "_scan_p", "left")
    goes_on = F.col("_scan_open") & F.col("_scan_sum").isNotNull()
    found = joined.withColumn(number, F.col("_scan_n") + F.when(goes_on, F.col("_scan_sum")).otherwise(0))
    if value:
        found = found.withColumn(before, F.when(goes_on & (F.col("_scan_n") == 1), F.col("_scan_last.v")).otherwise(F.col("_scan_before")))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), number, *([before] if value else []))


def children_pages(parents: DataFrame, key: str, children: DataFrame, order: tuple[str, ...], name: str = "children", size: int = 1_000) -> DataFrame:
    """JN5 in bounded rows: the columns of ``parents``, ``page`` from 0, and ``name``, an array of at most ``size`` children in order.

    A parent with many children has as many rows as it has pages; one without any has page 0 with an empty array.
    """
    others = [c for c in children.columns if c != key]
    paged = numbered(children.where(F.col(key).isNotNull()), key, order, number="_number").withColumn("page", F.floor((F.col("_number") - 1) / size).cast("int"))
    packed = paged.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct("_number", *others))).alias("_all"))
    packed = packed.select(key, "page", F.transform("_all", lambda x: F.struct(*(x[c].alias(c) for c in others))).alias(name))
    return parents.join(packed, key, "left").withColumns({"page": F.coalesce("page", F.lit(0)), name: F.coalesce(name, F.array())})
