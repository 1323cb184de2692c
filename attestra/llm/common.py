"""What the operators of this subpackage share: tables, cut lineage, text rules."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls 09-0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 2_000_000
HOT_KEYS, LEAST_HOT = 20_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without a cluster setting (tests), a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "attestra-checkpoints")
    return named.rstrip("/")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing lazy reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def hot_limit(rows: int) -> int:
    """Rows of one key beyond which it is hot: fewer than ``HOT_KEYS`` keys can be."""
    return max(LEAST_HOT, rows // HOT_KEYS)


def join_uses(rows: DataFrame, known: DataFrame, keys: list[str], uses: str) -> DataFrame:
    """Inner join of ``rows`` with ``known``, one row for each key with ``uses``, its number of rows: no task gets all rows of a hot key.

    Keys with more than a ``HOT_KEYS``-th of all rows are broadcast, so at most ``HOT_KEYS`` of them; the others are
    shuffled. Both tables should be written ones: each is read twice. Keys are not null.
    """
    total, most = known.agg(F.sum(uses), F.max(uses)).first()
    limit = hot_limit(total or 0)
    if (most or 0) <= limit:
        return rows.join(known, keys)
    hot = known.where(F.col(uses) > limit)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(known.where(F.col(uses) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from the driver's rows, sent as Arrow batches: no Python worker is started for it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], kind.type, from_pandas=False) if not pa.types.is_list(kind.type) else _lists([r[i] for r in rows], kind.type) for i, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), schema)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind.value_type] if pa.types.is_struct(kind.value_type) else None
    return pa.array([[dict(zip(names, x, strict=True)) if names else x for x in v] for v in values], kind)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a text column, one row at least; the bytes are not copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = (np.cumsum(sizes) - sizes) // most  # rows that begin in the same stretch of bytes
    cuts = np.flatnonzero(np.diff(slot, prepend=-1, append=-1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that was freed back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator
        pass


def bounded(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches bounded by the bytes of a text column, however long the texts; what it held is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(part for batch in batches for part in slices(batch, column))
        finally:
            release()

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the quick built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
