"""Reading and writing of seeds, results, runs, files and manifests (SRC1-SRC16, SNK1-SNK12)."""

from __future__ import annotations

import json
import os
import shutil
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.records import append_keep_first, file_keys
from attestra.sources import files as files_source
from attestra.sources import schemas, sqlite
from attestra.sources.keyed import append_keyed
from attestra.sources.quoted import read_quoted

PUSHED_IDS = 1_000


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; without one only a local master has a folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "attestra-checkpoints")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back. What made it (a model, a random draw) is not run again, even
    if executors are lost."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_dataset(spark: SparkSession, path: str, schema: str = schemas.DATASET) -> DataFrame:
    """SRC1, SRC2, SRC13: CSV with a header, by column name; a leading byte order mark is dropped. A large file is read by many tasks, line breaks inside quotes or not."""
    header = spark.read.text(path).limit(1).first()
    if header is None:
        return spark.createDataFrame([], schema)
    quoted = read_quoted(spark, path)
    kinds = [x.strip().split(" ", 1) for x in schema.split(",")]
    have = set(quoted.columns)
    known = [F.col(n).try_cast(k).alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in kinds]
    return quoted.select(*known, *(c for c in quoted.columns if c not in {n for n, _ in kinds}))


def resolved_path(path: Column, root: str) -> Column:
    """SRC3: relative paths are below the seed's folder; absolute and empty ones stay, ``~`` is the home folder."""
    home = F.regexp_replace(path, r"^~(?=/|$)", os.path.expanduser("~"))
    return F.when(path.isNull() | (path == "") | home.startswith("/"), home).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def missing_files(rows: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """SRC4: rows whose file isn't in a listing with a column ``path``."""
    there = listing.select(F.regexp_replace("path", "^file:/*", "/").alias(path))
    return rows.where(F.col(path).isNotNull() & (F.col(path) != "")).join(there, path, "left_anti")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC5, SRC6: results of a run, or of all runs below a folder of ``run_id=...`` partitions; none is an empty table."""
    try:
        return spark.read.schema(schemas.RESULTS + ", run_id string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schemas.RESULTS + ", run_id string")
        raise


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """SRC7: a run's metadata; without a file its id alone."""
    try:
        return spark.read.schema(schemas.RUN).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.sql(f"SELECT {json.dumps(run_id)} AS run_id")
        raise


def read_files(spark: SparkSession, root: str, pattern: str = "*.pdf", ids: DataFrame | None = None, id_col: str = "id", content: bool = True) -> DataFrame:
    """SRC9: files one folder below a root, with their folder's name as ``guarantee_id``; only files of the ids asked for are opened.

    A list of ids within a bound goes to the source as a filter, a longer one is a semi-join. ``content=False`` lists without opening.
    """
    files_source.register(spark)
    parts = 4 * spark.sparkContext.defaultParallelism
    found = spark.read.format("document_files").option("pattern", pattern).option("parts", parts).option("content", str(content).lower()).load(root)
    if ids is None:
        return found
    wanted = ids.select(F.col(id_col).cast("string").alias("guarantee_id")).where("guarantee_id IS NOT NULL").distinct()
    few = [r[0] for r in wanted.limit(PUSHED_IDS + 1).collect()]
    return found.where(F.col("guarantee_id").isin(few)) if len(few) <= PUSHED_IDS else found.join(wanted, "guarantee_id", "left_semi")


def pages(files: DataFrame, open_file: Callable[[bytes, str], list], run_page: Callable[[object, int], dict]) -> DataFrame:
    """SRC8: pages of files, by an opener and an engine given by the caller (their libraries are not part of this
    package). An engine is opened once in a Python worker. A file that can't be opened gives a row with its error."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = [(path, i, json.dumps(run_page(image, i), ensure_ascii=False), None) for i, image in enumerate(open_file(bytes(content), path))]
                except Exception as e:  # noqa: BLE001  any file may be broken; its row says how
                    found = [(path, None, None, str(e)[:2000])]
                out += found
            yield pd.DataFrame(out, columns=["path", "page_index", "page_json", "error"]).astype({"page_index": "Int32"})

    return files.select("path", "content").mapInPandas(explode, "path string, page_index int, page_json string, error string")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: first column of a CSV without header, blanks left out."""
    rows = spark.read.csv(path)
    return rows.select(F.trim(F.col(rows.columns[0])).alias("id")).where("id <> ''")


def read_truth(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC11: one JSON file a document, keyed by the file's stem."""
    _, stem = file_keys(F.input_file_name())
    return spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True).withColumn("stem", stem)


def read_weights(given: str) -> dict[str, float]:
    """SRC12: weights from a JSON file or from JSON itself."""
    text = Path(given).read_text(encoding="utf-8") if os.path.isfile(given) else given
    return {k: float(v) for k, v in json.loads(text).items()}


def _named(column: str) -> str:
    """A column as Spark's own statements name it."""
    return '"' + column.replace('"', '""') + '"'


def _table(spark: SparkSession, url: str, name: str, predicates: list[str] | None = None) -> DataFrame:
    """A table, a partition for each predicate: ``sqlite:`` URLs by their own source, others by JDBC."""
    if not url.startswith("sqlite:"):
        return spark.read.jdbc(url, name, predicates=predicates) if predicates else spark.read.jdbc(url, name)
    sqlite.register(spark)
    return spark.read.format("sqlite_table").option("table", name).option("predicates", json.dumps(predicates or [])).load(sqlite.path_of(url))


def _ends(spark: SparkSession, url: str, name: str, key: str, held: str) -> tuple | None:
    ends = f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}{held}"
    if not url.startswith("sqlite:"):
        return spark.read.jdbc(url, f"({ends}) t").first()
    base = sqlite.connected(sqlite.path_of(url))
    try:
        return base.execute(ends).fetchone()
    finally:
        base.close()


def _keys(spark: SparkSession, url: str, name: str, key: str, held: str, ends: tuple, parts: int) -> DataFrame:
    """The key column alone, by even ranges between its ends."""
    if not url.startswith("sqlite:"):
        return spark.read.jdbc(url, f"(SELECT {key} FROM {name}{held}) t", column=key.strip(chr(34)), lowerBound=ends[0], upperBound=ends[1], numPartitions=parts)
    steps = [ends[0] + (ends[1] - ends[0]) * i / parts for i in range(1, parts)]
    ranges = [f"{key} < {steps[0]!r} OR {key} IS NULL", *(f"{key} >= {a!r} AND {key} < {b!r}" for a, b in zip(steps, steps[1:], strict=False)), f"{key} >= {steps[-1]!r}"]
    where = held.removeprefix(" WHERE ")
    return _table(spark, url, name, [f"({r}) AND ({where})" if where else r for r in ranges]).select(key.strip('"').replace('""', '"'))


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, where: str | None = None) -> DataFrame:
    """SRC16: a database table; with a numeric key in ``parts`` ranges of near equal numbers of rows, however the keys lie.

    ``url`` is a JDBC URL, or ``sqlite:`` and a file that driver and executors share. The key column alone is read first,
    by even ranges between its ends, to find the cuts. ``where``, in the database's
    SQL, holds for both readings; filters put on the result reach the database too. Rows with a null key are in the first range.
    """
    if key is None:
        return _table(spark, url, name)
    key = _named(key)
    held = f" WHERE {where}" if where else ""
    ends = _ends(spark, url, name, key, held) if parts > 1 else None
    if ends is None or ends[0] is None:
        return _table(spark, url, name, [where] if where else None)
    keys = _keys(spark, url, name, key, held, ends, parts)
    column = keys.columns[0]
    from attestra.operators.ranks import even_cuts

    cuts = even_cuts(materialised(keys.select(F.col(column).alias("key"))), "key", parts)
    whole = dict(keys.dtypes)[column] in ("int", "bigint", "smallint", "tinyint")
    cuts = sorted({int(-(-c // 1)) if whole else c for c in cuts})
    ranges = [f"{key} < {cuts[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{key} >= {cuts[-1]}"]
    return _table(spark, url, name, [f"({r}) AND ({where})" if where else r for r in ranges])


def write_batch(rows: DataFrame, url: str, name: str, batch: int, column: str = "batch", types: str | None = None) -> None:
    """SNK12: rows of one numbered batch into a database table; a batch given again takes the place of what it had written.

    ``types`` are the columns' types in a JDBC database, for a table that is not there yet.
    """
    numbered = rows.withColumn(column, F.lit(int(batch)))
    if url.startswith("sqlite:"):
        path = sqlite.path_of(url)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if sqlite.columns_of(path, name):
            base = sqlite.connected(path, write=True)
            try:
                base.execute(f"DELETE FROM {name} WHERE {_named(column)} = {int(batch)}")
            finally:
                base.close()
        sqlite.register(rows.sparkSession)
        numbered.write.format("sqlite_table").option("table", name).mode("append").save(path)
        return
    manager = rows.sparkSession._jvm.java.sql.DriverManager
    connection = manager.getConnection(url)
    try:
        if connection.getMetaData().getTables(None, None, name.upper(), None).next():
            connection.createStatement().executeUpdate(f"DELETE FROM {name} WHERE {_named(column)} = {int(batch)}")
    finally:
        connection.close()
    writer = numbered.write.mode("append")
    (writer.option("createTableColumnTypes", types) if types else writer).jdbc(url, name)


def write_results(rows: DataFrame, path: str) -> None:
    """SNK1."""
    rows.write.mode("overwrite").parquet(path)


def append_results(new: DataFrame, path: str, key: str = "id", once: bool = True) -> None:
    """SNK2: adds the rows whose key isn't there; of what is there only the keys of files that may have one of them are read."""
    append_keyed(new, path, key, once)


def write_seed(rows: DataFrame, path: str) -> None:
    """SNK3: one CSV file of a bounded sample."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(spark: SparkSession, path: str, fields: dict) -> None:
    """SNK4."""
    row = spark.range(1).select(F.from_json(F.lit(json.dumps(fields)), schemas.RUN).alias("r")).select("r.*")
    row.coalesce(1).write.mode("overwrite").json(path)


def run_id(engine: Column, extractor: Column) -> Column:
    """SNK5: time in UTC, engine, extractor and six random hex digits."""
    now = F.date_format(F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()), "yyyyMMdd'T'HHmmss")
    return F.concat_ws("_", now, engine, extractor, F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def write_artifacts(rows: DataFrame, root: str, copy_source: bool = False) -> None:
    """SNK6, SNK7: files of each document below ``root/<guarantee_id>/<stem>/``, moved into place by tasks when all that write have ended.

    ``rows`` has ``guarantee_id, stem`` and the columns ``ocr_json, ocr_md, extraction_json,
    meta_json``, and ``content`` if the source is kept; null columns write no file. ``root``
    must be a folder that all executors share.
    """
    spark = rows.sparkSession
    files_source.register(spark)
    columns = ["guarantee_id", "stem", *(c for c in files_source.ARTIFACT_COLUMNS if c in rows.columns and (copy_source or c != "content"))]
    os.makedirs(files_source.local_path(root), exist_ok=True)
    name = uuid.uuid4().hex
    place = files_source.local_path(root)
    staging = os.path.join(place, files_source.STAGING, name)

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempts = files_source.committed(staging)
        for part in parts:
            for bucket in part["id"]:
                files_source.move_bucket(staging, place, attempts, bucket)
            yield part

    try:
        rows.select(*columns).write.format("document_artifacts").option("staging", name).mode("append").save(root)
        spark.range(0, files_source.BUCKETS, 1, files_source.BUCKETS).mapInPandas(move, "id long").write.format("noop").mode("overwrite").save()
    finally:
        files_source.clear(staging)


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK9: totals of a bulk run as one row, and its failures as rows of ``path, error``. ``rows``: ``path, ok, error``."""
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return totals, rows.where(~F.col("ok")).select("path", "error")


def legacy_report(rows: DataFrame) -> DataFrame:
    """SNK10, A23: ``rows`` has ``skipped, matched, latency_ms``; means are over documents not skipped, at least one."""
    n = F.greatest(F.count(F.lit(1)) - F.count_if("skipped"), F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("skipped").alias("skipped"), F.count_if(F.col("matched") & ~F.col("skipped")).alias("matched"),
        (F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("latency_ms"))), F.lit(0.0)) / n).alias("avg_latency_ms"),
    )


def bundle(rows: DataFrame, out_dir: str, name: str = "sample.csv") -> DataFrame:
    """SNK11: rows of a portable bundle: the file's unique name (W7) instead of its path, the old ones beside it."""
    from attestra.operators.records import unique_names

    base = rows.withColumn("_base", F.coalesce(F.nullif(F.col("stored_filename"), F.lit("")), F.regexp_extract("stored_path", r"([^/]*)$", 1)))
    named = unique_names(base, "_base", "id")
    return named.select(
        *(c for c in rows.columns if c not in ("stored_path", "stored_filename")), F.concat(F.lit("files/"), "unique_name").alias("stored_path"), F.col("unique_name").alias("stored_filename"),
        F.col("stored_path").alias("original_stored_path"), F.col("stored_filename").alias("original_stored_filename"), F.col("unique_name").alias("bundle_filename"),
    )


def write_bundle(rows: DataFrame, out_dir: str, archive: str | None = None) -> None:
    """SNK11: copies the files of a (bounded) bundle, writes its CSV, packs it as ``tar.gz`` or ``zip``."""
    os.makedirs(os.path.join(out_dir, "files"), exist_ok=True)
    for r in rows.select("original_stored_path", "stored_path").toLocalIterator():
        shutil.copy2(r["original_stored_path"], os.path.join(out_dir, r["stored_path"]))
    rows.toPandas().to_csv(os.path.join(out_dir, "sample.csv"), index=False)
    if archive == "zip":
        with zipfile.ZipFile(f"{out_dir}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(Path(out_dir).rglob("*")):
                z.write(p, p.relative_to(Path(out_dir).parent))
    elif archive == "tar":
        with tarfile.open(f"{out_dir}.tar.gz", "w:gz") as t:
            t.add(out_dir, arcname=os.path.basename(out_dir))


def upsert_versions(existing: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """SNK12: an update is a further row; the newest of each key is the table's state (``records.latest``)."""
    return existing.unionByName(changes, allowMissingColumns=True)


def keep_first(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return append_keep_first(existing, new, key)
