"""Extraction by a model with checks and retries (X13), and the extractor switch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.structured import json_schema, with_validated
from attestra.functions.text import SYSTEM_PROMPT, dates, extract, question, with_roles, within_budget
from attestra.sources.tables import materialised

#: A model's call: system prompt, question, JSON schema of the answer. With an attribute ``many`` (the same for a list of questions) it is called in batches.
Generate = Callable[[str, str, dict], str]
BATCH = 64


def _answers(asked: DataFrame, make: Callable[[], Generate], version: str) -> DataFrame:
    """``_row, raw, failure`` from ``_row, _text, _errors``. The model is made once for each batch stream of a Python worker; its failure is the row's error."""
    schema = json_schema(version)

    def one(generate: Generate, q: str) -> tuple[str | None, str | None]:
        try:
            return generate(SYSTEM_PROMPT, q, schema), None
        except Exception as e:  # noqa: BLE001  any model may fail; the row says how
            return None, str(e)[:2000]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make()
        many = getattr(generate, "many", None)
        for batch in batches:
            questions = [question(t, version, e) for t, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found: list[tuple[str | None, str | None]] = []
            for i in range(0, len(questions), BATCH):
                part = questions[i : i + BATCH]
                try:
                    if not many:
                        raise NotImplementedError
                    found += [(a, None) for a in many(SYSTEM_PROMPT, part, schema)]
                except Exception:  # noqa: BLE001  one bad question doesn't fail its batch
                    found += [one(generate, q) for q in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["_row", "raw", "failure"])

    return asked.mapInArrow(run, f"_row {asked.schema['_row'].dataType.simpleString()}, raw string, failure string")


def extract_by_model(docs: DataFrame, make: Callable[[], Generate], text: str = "text", version: str = "v2", retries: int = 2, key: str | None = None) -> DataFrame:
    """Adds ``status, record, raw, errors, warnings, attempts``.

    ``make`` gives a call that takes the system prompt, a question and the JSON schema of the answer.
    Each attempt asks for the rows that are still invalid, the errors of the attempt before in
    the question; errors are those of the last attempt. A model that fails ends a row at once
    as ``failed_runtime``. Attempts are separate passes over fewer and fewer rows. Questions are
    made where the model is; what is written of an attempt is ``key`` (unique, not null), the answer and what
    was found in it. Without a key the documents are numbered and written first. A null text is asked as an empty one.
    """
    if key is None:
        base, mark = materialised(docs.withColumn("_row", F.monotonically_increasing_id())), "_row"
    else:
        base, mark = docs, key
    texts = base.select(F.col(mark).alias("_row"), within_budget(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    asked = texts.withColumn("_errors", F.lit(None).cast("array<string>"))
    done: DataFrame | None = None
    for attempt in range(1, retries + 2):
        answered = _answers(asked.select("_row", "_text", "_errors"), make, version)
        checked = with_validated(answered, "raw", version)
        failed = F.col("failure").isNotNull()
        ok = F.size("errors") == 0
        status = F.when(failed, "failed_runtime").when(ok, "succeeded").otherwise("failed_validation")
        errors = F.when(failed, F.array("failure")).otherwise(F.col("errors"))
        # The joins below are sorted ones: from the files' sizes, that of a few columns beside the wide record is taken for far less than it is, and millions of rows would be broadcast.
        # Written: a model is asked once for each attempt, and an answer is checked once.
        rows = checked.select("_row", status.alias("status"), F.when(~failed, F.col("record")).alias("record"), "raw", errors.alias("errors"), "warnings", F.lit(attempt).alias("attempts"))
        rows = materialised(rows)
        last = attempt == retries + 1
        finished = rows if last else rows.where("status <> 'failed_validation'")
        done = finished if done is None else done.unionByName(finished)
        if not last:
            asked = texts.hint("merge").join(rows.where("status = 'failed_validation'").select("_row", F.col("errors").alias("_errors")), "_row")
    joined = base.hint("merge").join(done.withColumnRenamed("_row", "_answered"), F.col(mark) == F.col("_answered"))
    return joined.select(*docs.columns, "status", "record", "raw", "errors", "warnings", "attempts")


def extract_by_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """X7 as an extractor: adds ``record``."""
    held = with_roles(docs, text, "_who").withColumn("_dates", dates(F.col(text)))
    return held.withColumn("record", extract(F.col(text), F.col("_dates"), F.col("_who"))).drop("_dates", "_who")
