"""Jobs, runs and samples: joins, latest-per-key, versions, pages, names, set operations
(JN1-JN6, U1-U4, W1-W4, W7, W10, W11, P2-P5, SNK2, SRC14, SRC15, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted file types.
FILE_TYPES = ("pdf", "tif", "tiff", "png", "jpg", "jpeg")


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """JN1, U3: rows whose key isn't done yet. Rows with a null key are always pending."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def requested(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """JN3: rows whose key is asked for."""
    return rows.join(wanted.select(key), key, "left_semi")


def append_keep_first(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """SNK2, JN2, U1: new rows are added unless their key is there; repeats within the new rows stay."""
    return existing.unionByName(pending(new, existing, key), allowMissingColumns=True)


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """JN4: left lookup; a row without a fact stays."""
    return rows.join(facts, key, "left")


def with_missing_fields(diags: DataFrame, keys: list[str], fields: list[str], docs: DataFrame | None = None) -> DataFrame:
    """JN6: every document of ``docs`` (None: of ``diags``) has every field; one without a diagnosis is no match, ``missing``. Keys may be null.

    The fields of a document are packed before the join, so that one row of each document is shuffled, not one of each field.
    """
    others = [c for c in diags.columns if c not in (*keys, "field")]
    packed = diags.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.collect_list(F.struct("field", *others)).alias("_rows"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = (diags if docs is None else docs).select(*keys).distinct().join(packed, on, "left").withColumn("field", F.explode(F.array(*(F.lit(f) for f in fields))))
    of = F.filter(F.coalesce("_rows", F.array().cast(packed.schema["_rows"].dataType)), lambda r: r["field"] == F.col("field"))
    nothing = F.struct(F.col("field"), *(F.lit(None).cast(diags.schema[c].dataType).alias(c) for c in others))
    each = joined.select(*keys, F.explode(F.when(F.size(of) > 0, of).otherwise(F.array(nothing))).alias("x")).select(*keys, "x.*")
    return each.fillna({"is_match": False, "error_type": "missing"})


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, by one pre-aggregated maximum rather than a sort of the group."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("x"))
    return newest.select(key, *(F.col(f"x.{c}").alias(c) for c in others))


def versions(rows: DataFrame, key: str, at: str, tie: str, payload: str) -> DataFrame:
    """Corrections numbered from 1 in time order, each with the payload before it; a job may span many tasks."""
    from attestra.operators.scan import numbered

    return numbered(rows, key, (at, tie), payload)


def checked_corrections(corrections: DataFrame, jobs: DataFrame, key: str, payload: str, status: str = "status") -> DataFrame:
    """W3's guards: ``corrections`` with ``refused``, why a row may not be taken, or null. The first reason counts: no such job,
    a payload that is no JSON object, a job that has not ended. ``jobs`` has one row for each key; a null key names no job."""
    known = jobs.select(F.col(key).alias("_job"), F.col(status).alias("_status"))
    joined = corrections.join(known, F.col(key) == F.col("_job"), "left")
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("_job").isNull(), "unknown job").when(~sound, "bad body").when(~F.coalesce(F.col("_status").isin("succeeded", "failed"), F.lit(False)), "job has not ended")
    return joined.withColumn("refused", reason).drop("_job", "_status")


def with_children(jobs: DataFrame, key: str, one: dict[str, DataFrame], many: dict[str, DataFrame]) -> DataFrame:
    """JN5: one struct of each single relation, one array of each multiple one (empty if there is none). For relations
    without a bound of their own take ``scan.children_pages``."""
    out = jobs
    for name, table in one.items():
        out = out.join(table.select(key, F.struct(*(c for c in table.columns if c != key)).alias(name)), key, "left")
    for name, table in many.items():
        packed = table.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in table.columns if c != key)))).alias(name))
        out = out.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, **equal: str | None) -> DataFrame:
    """P2, W1, VR7: optional filters, newest first; ``limit`` from 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order).offset(offset).limit(limit)


def by_id(rows: DataFrame, value: object, key: str = "id") -> DataFrame:
    """P3."""
    return rows.where(F.col(key) == value)


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows, or all; the draw depends on seed and key alone, not on how rows are stored."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.orderBy(order, key).limit(n)


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``names.unique_names``."""
    from attestra.operators import names

    return names.unique_names(rows, name, order)


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows in key order in batches of a fixed size, numbered from 0, without bringing them into one task.

    Rows are ranged by key; the counts of the ranges, a row each, give every range its start.
    """
    ranged = rows.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_s"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.join(F.broadcast(starts), "_p").withColumn("batch", F.floor((F.col("_s") + at) / size).cast("long")).drop("_p", "_s")


def file_keys(path: Column) -> tuple[Column, Column]:
    """SRC14: key and stem of a file name; the key is the stem up to its last ``_``."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)
    return F.when(stem.contains("_"), F.regexp_extract(stem, r"(?s)^(.*)_[^_]*$", 1)).otherwise(stem), stem


def seed_of(name: Column) -> Column:
    """SRC15."""
    return F.nullif(F.regexp_extract(name, r"seed=(\d+)", 1), F.lit("")).try_cast("int")


def allowed_type(name: Column) -> Column:
    """P4."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*FILE_TYPES)


def under_roots(path: Column, roots: list[str]) -> Column:
    """P5: a resolved path that is one of the roots or below one."""
    inside = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        inside = inside | (path == root) | path.startswith(f"{root}/")
    return inside & ~path.rlike(r"(^|/)\.\.(/|$)")


def error_message(errors: Column) -> Column:
    """The first three errors."""
    return F.array_join(F.slice(errors, 1, 3), "; ")


def trace_tail(trace: Column) -> Column:
    """W10."""
    return F.right(trace, F.lit(500))


def stored_message(message: Column) -> Column:
    """W10."""
    return F.left(message, F.lit(2000))


def remaining_ms(elapsed_ms: Column, processed: Column, total: Column) -> Column:
    """Time left at the pace so far; null before the first document."""
    return F.try_divide(elapsed_ms, processed) * (total - processed)
