"""Inputs derived from the driver's tables by expressions that Spark and other SQL engines read alike.

``k`` is the order's key. Values are true by rule; predictions are altered by other rules, so
that every kind of error occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _iso(days: int) -> str:
    return f"cast(cast(cast(o_orderdate as date) + interval {days} day as date) as string)"


def _dotted(iso: str, mark: str = ".") -> str:
    return f"concat(substr({iso}, 9, 2), '{mark}', substr({iso}, 6, 2), '{mark}', substr({iso}, 1, 4))"


K = "o_orderkey"
MONEY = "cast(cast(o_totalprice as decimal(12,2)) as string)"
MONEY_OFF = "cast(cast(o_totalprice + 0.5 as decimal(12,2)) as string)"
PRINCIPAL = "lpad(cast(o_custkey * 7919 + 1 as string), 10, '7')"
BENEFICIARY = "lpad(cast(o_custkey * 104729 + 3 as string), 12, '5')"
IKZ = f"lpad(cast({K} as string), 36, '1')"
OTHER_LAST = "concat(substr({0}, 1, {1}), cast((cast(substr({0}, {2}, 1) as int) + 1) % 10 as string))"

GOLD_PRED = {
    "id": K,
    "ocr_engine": f"case when {K} % 2 = 0 then 'tesseract' else 'paddleocr' end",
    "extractor": f"case when {K} % 3 = 0 then 'regex' else 'llm' end",
    "status": f"case when {K} % 23 = 0 then 'failed' when {K} % 31 = 0 then 'extraction_failed' else 'succeeded' end",
    "ocr_ms": f"cast(1000 + {K} % 97 * 3.5 as double)",
    "extract_ms": f"cast({K} % 53 * 20.0 as double)",
    "total_ms": f"cast(1000 + {K} % 97 * 3.5 + {K} % 53 * 20.0 as double)",
    "gold_pcpl_inn": PRINCIPAL,
    "pred_pcpl_inn": f"case when {K} % 11 = 0 then null when {K} % 7 = 0 then {OTHER_LAST.format(PRINCIPAL, 9, 10)} else concat('INN ', substr({PRINCIPAL}, 1, 4), ' ', substr({PRINCIPAL}, 5, 6)) end",
    "gold_bene_inn": f"case when {K} % 41 = 0 then null else {BENEFICIARY} end",
    "pred_bene_inn": f"case when {K} % 10 = 0 then null when {K} % 9 = 0 then {OTHER_LAST.format(BENEFICIARY, 11, 12)} else concat(substr({BENEFICIARY}, 1, 2), '-', substr({BENEFICIARY}, 3, 10)) end",
    "gold_issue_date": _iso(0),
    "pred_issue_date": f"case when {K} % 13 = 0 then null when {K} % 3 = 0 then {_dotted(_iso(0))} when {K} % 3 = 1 then {_dotted(_iso(0), '/')} else {_iso(0)} end",
    "gold_start_date": _iso(30),
    "pred_start_date": f"case when {K} % 19 = 0 then {_iso(31)} else {_dotted(_iso(30))} end",
    "gold_end_date": _iso(365),
    "pred_end_date": f"case when {K} % 21 = 0 then null else concat({_iso(365)}, 'T00:00:00') end",
    "gold_sum": f"case when {K} % 29 = 0 then null else {MONEY} end",
    "pred_sum": f"case when {K} % 17 = 0 then null when {K} % 5 = 0 then replace({MONEY_OFF}, '.', ',') else concat({MONEY}, ' руб') end",
    "gold_currency": "'RUB'",
    "pred_currency": f"case when {K} % 4 = 0 then 'руб.' when {K} % 4 = 1 then '₽' when {K} % 4 = 2 then 'usd' else 'rub' end",
    "gold_ikz": f"case when {K} % 37 = 0 then null else {IKZ} end",
    "pred_ikz": f"case when {K} % 15 = 0 then null when {K} % 14 = 0 then concat('0', {IKZ}) else concat('IKZ ', {IKZ}) end",
}

OCR_TEXT = {
    "id": K,
    "inn_1": PRINCIPAL,
    "inn_2": BENEFICIARY,
    "date_1": _iso(0),
    "price": "cast(cast(o_totalprice as decimal(12,2)) as double)",
    "text": f"concat('Принципал ИНН ', {PRINCIPAL}, ', бенефициар ИНН ', {BENEFICIARY}, '. Дата ', {_dotted(_iso(0))}, ' по ', {_dotted(_iso(30))}, '. Сумма ', {MONEY}, ' руб. ИКЗ: ', {IKZ})",
}

JOB_LOG = {"job_id": "cast(user_id as string)", "id": "event_id", "created_at": "ts", "payload": "props", "status": "case when event_type = 'error' then 'failed' else 'succeeded' end"}


def select(view: dict[str, str], table: str) -> str:
    """SQL of a view, for engines other than Spark."""
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in view.items())} FROM {table}"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table dealt over all slots and in parts of some 4 MB of its files, so that no task is long; one of many splits for each slot as it is."""
    slots, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(max(slots, 32 * splits)) if splits < 8 * slots else rows


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table as stored, dealt by a key in parts of some 8 MB: what is made of a row, however much, stays in its part, and groupings by the key and more shuffle nothing."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(2 * slots, 16 * rows.rdd.getNumPartitions()), key)


def view(spark: SparkSession, sf_dir: str, columns: dict[str, str], table: str) -> DataFrame:
    return spread(load(spark, sf_dir, table)).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
