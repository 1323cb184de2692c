"""Registered queries of single rules: checks, prompts, names, messages, small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions import structured as S
from attestra.functions import text as X
from attestra.operators import evaluation as E
from attestra.operators import layout as L
from attestra.operators import records as R
from attestra.operators.extraction import extract_by_model, extract_by_patterns
from attestra.plans import queries as Q
from attestra.plans import views as V
from attestra.plans.registry import ORACLES, query
from attestra.sources import tables as T
from attestra.streaming.jobs import allowed_step


@query("SELECT o_orderkey AS id, printf('%.1f%%', o_totalprice / 10000) AS share, printf('%.3f', o_totalprice / 7) AS number, '—' AS dash FROM orders")
def percent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13."""
    rows, none = V.load(spark, sf_dir, "orders"), F.lit(None).cast("double")
    return rows.select(F.col("o_orderkey").alias("id"), N.percent(F.col("o_totalprice"), F.lit(1000000)).alias("share"), N.decimals(F.col("o_totalprice") / 7, 3).alias("number"), N.percent(none).alias("dash"))


@query("SELECT doc_id, concat(substr(sha256(text), 1, 16), '_', source, '.txt') AS name FROM documents")
def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N16."""
    return V.load(spark, sf_dir, "documents").select("doc_id", N.content_name(F.col("text"), F.concat("source", F.lit(".txt"))).alias("name"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN [7, 8, 9, 10] WHEN s_suppkey % 3 = 1 THEN [s_nationkey, 1, s_suppkey + 30, 20] ELSE [0, 0, 0, 0] END::VARCHAR AS bbox FROM supplier")
def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon, else a box, else zeros."""
    rows = V.load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "if(s_suppkey % 3 = 1, array(array(s_suppkey + 30.5D, 20D), array(cast(s_nationkey AS double), 1.9D)), null) AS polygon", "if(s_suppkey % 3 = 2, null, array(7.2D, 8D, 9D, 10D)) AS box")
    return rows.select("id", F.concat(F.lit("["), F.array_join(L.polygon_bbox(F.col("polygon"), F.col("box")).cast("array<string>"), ", "), F.lit("]")).alias("bbox"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice / (o_custkey % 4) * (10 - o_custkey % 4) END AS remaining FROM orders")
def remaining_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return V.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), R.remaining_ms(F.col("o_totalprice"), F.col("o_custkey") % 4, F.lit(10)).alias("remaining"))


@query("SELECT count(*) AS documents, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS matched, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P') / greatest(count(*) FILTER (o_orderstatus <> 'P'), 1), 4) AS avg_latency_ms FROM orders")
def legacy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, SNK10."""
    rows = V.load(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "P").alias("skipped"), (F.col("o_orderstatus") == "F").alias("matched"), F.col("o_totalprice").alias("latency_ms"))
    return T.legacy_report(rows).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


@query("SELECT 'total' AS path, cast(count(*) AS string) AS value FROM orders UNION ALL SELECT 'failed', cast(count(*) AS string) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT concat('/in/', o_orderkey), 'unreadable' FROM orders WHERE o_orderstatus = 'P'")
def bulk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: totals, and failures as rows."""
    rows = V.load(spark, sf_dir, "orders").select(F.concat(F.lit("/in/"), "o_orderkey").alias("path"), (F.col("o_orderstatus") != "P").alias("ok"), F.lit("unreadable").alias("error"))
    totals, failures = T.manifest(rows)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in ("total", "failed"))))
    return totals.select(each.alias("x")).select("x.*").unionByName(failures.withColumnRenamed("error", "value"))


@query("SELECT doc_id, concat(lang, '; ', source, '; e3') AS message, right(text, 500) AS tail, left(text, 2000) AS stored FROM documents")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four errors, the end of a trace, a bounded message."""
    t = F.col("text")
    return V.load(spark, sf_dir, "documents").select("doc_id", R.error_message(F.array("lang", "source", F.lit("e3"), F.lit("e4"))).alias("message"), R.trace_tail(t).alias("tail"), R.stored_message(t).alias("stored"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def job_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    rows = V.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.by_id(rows, rows.agg(F.max("o_orderkey")).first()[0], "o_orderkey")


@query("SELECT page_id, path, (path = '/data/in' OR path LIKE '/data/in/%') AND NOT contains(path, '/../') AS allowed FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/data/in/', page_id) WHEN 1 THEN '/data/in' WHEN 2 THEN concat('/data/input/', page_id) ELSE '/data/in/../etc' END AS path FROM pages)")
def allowed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    rows = V.load(spark, sf_dir, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN concat('/data/in/', page_id) WHEN 1 THEN '/data/in' WHEN 2 THEN concat('/data/input/', page_id) ELSE '/data/in/../etc' END AS path")
    return rows.select("page_id", "path", R.under_roots(F.col("path"), ["/data/in/"]).alias("allowed"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'v1' ELSE 'v2' END AS version FROM orders")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown and absent ones are v2."""
    given = F.when(F.col("o_orderstatus") == "O", "v1").when(F.col("o_orderstatus") == "F", "v3")
    return V.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.schema_version(given).alias("version"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'en_PP-OCRv5_mobile_rec' WHEN 1 THEN 'latin_PP-OCRv5_mobile_rec' WHEN 2 THEN 'eslav_PP-OCRv5_mobile_rec' ELSE 'PP-OCRv5_mobile_rec' END AS model FROM nation")
def recognisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17."""
    lang = F.element_at(F.array(F.lit(" ENG "), F.lit("deu"), F.lit("unknown"), F.lit("chi_sim")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return V.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), N.recogniser(lang).alias("model"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TAIL = {v: f"Schema template ({v}):\n```json\n{X.template(v)}\n```\n\nOCR text:\n---\n" for v in ("v1", "v2")}


@query(f"SELECT doc_id, md5(concat({_quoted(X.ASK + _TAIL['v2'])}, text, chr(10), '---')) AS first, md5(concat({_quoted(X.ASK_AGAIN + '- ')}, lang, chr(10), '- second', {_quoted(chr(10) * 2 + _TAIL['v1'])}, text, chr(10), '---')) AS again FROM documents")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First questions and repeated ones."""
    t = F.col("text")
    return V.load(spark, sf_dir, "documents").select("doc_id", F.md5(X.prompt(t)).alias("first"), F.md5(X.prompt(t, "v1", F.array("lang", F.lit("second")))).alias("again"))


@query("SELECT 'v' || v AS version, k AS key FROM (SELECT 1 AS v, unnest(" + str(X.RECORD_KEYS["v1"]) + ") AS k UNION ALL SELECT 2, unnest(" + str(X.RECORD_KEYS["v2"]) + "))")
def json_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the schema of each version."""
    rows = [(v, k) for v in ("v1", "v2") for k in S.json_schema(v)["properties"]]
    return spark.createDataFrame(rows, "version string, key string")


_CHECKED = "concat('{\"ikz\": ', if(o_orderkey % 5 = 0, '\"none\"', concat('\"', o_orderkey, '\"')), ', \"issue_date\": \"', cast(cast(o_orderdate as date) as string), '\", \"end_date\": \"', if(o_orderkey % 7 = 0, '1990-01-01', '2030-01-01'), '\", \"extraction_confidence\": ', if(o_orderkey % 3 = 0, '1.5', '0.5'), ', \"odd\": 1}')"


@query("SELECT o_orderkey AS id, (o_orderkey % 5 = 0)::int AS ikz_errors, (o_orderkey % 3 = 0)::int AS confidence_errors, (o_orderkey % 7 = 0)::int AS order_warnings, 'odd' AS unknown FROM orders")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VR2, VR4-VR6 on v1 records."""
    rows = V.load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CHECKED} AS answer")
    checked = S.with_validated(rows, "answer", "v1", unknown="unknown")
    about = lambda c, word: F.size(F.filter(c, lambda e: e.contains(word)))
    return checked.select(
        F.col("o_orderkey").alias("id"), about("errors", "IKZ must").alias("ikz_errors"), about("errors", "between 0 and 1").alias("confidence_errors"),
        about("warnings", "is after").alias("order_warnings"), F.array_join("unknown", ",").alias("unknown"),
    )


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'failed_runtime' WHEN o_orderstatus = 'P' THEN 'failed_validation' ELSE 'succeeded' END AS status, CASE WHEN o_orderstatus = 'F' THEN lpad(o_custkey::string, 10, '7') END AS principal_inn, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 2 END AS attempts FROM orders")
def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13 with a stand-in for a model: it fails, answers wrongly, or answers rightly when asked again."""

    def make():
        def generate(system: str, question: str, schema: dict) -> str:
            kind, inn = question.split("---\n")[-1].split("\n---")[0].split(" ")
            if kind == "O":
                raise RuntimeError("no model")
            again = question.startswith("Previous response")
            return json.dumps({"principal_inn": inn if kind == "F" and again and system and "properties" in schema else "12"})

        return generate

    docs = V.load(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat(o_orderstatus, ' ', lpad(cast(o_custkey AS string), 10, '7')) AS text")
    return extract_by_model(docs, make, retries=1, key="id").select("id", "status", F.col("record.principal_inn").alias("principal_inn"), "attempts")


@query(f"WITH t AS ({Q.OCR}) SELECT id, strftime(strptime(regexp_extract(text, 'Дата (\\d\\d\\.\\d\\d\\.\\d{{4}})', 1), '%d.%m.%Y'), '%Y-%m-%d') AS issue_date, price AS amount, 'RUB' AS currency, regexp_extract(text, 'ИКЗ: (\\d+)', 1) AS ikz, 'v1' AS schema_version FROM t")
def pattern_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of patterns."""
    rows = extract_by_patterns(Q.ocr(spark, sf_dir))
    return rows.select("id", *(F.col(f"record.{c}").alias(c) for c in ("issue_date", "amount", "currency", "ikz", "schema_version")))


_KIND = "CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'P' THEN 'евро' ELSE 'руб.' END"


@query(f"SELECT o_orderkey AS id, floor(o_totalprice) AS amount, CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'P' THEN 'EUR' ELSE 'RUB' END AS currency FROM orders")
def regex_other_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum after its word, in other currencies."""
    t = F.col("text")
    rows = V.load(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"concat('Размер: ', cast(floor(o_totalprice) AS string), ' ', {_KIND}) AS text")
    return rows.select("id", X.amount(t).alias("amount"), X.currency(t).alias("currency"))


@query("SELECT o_orderkey AS id, lpad(o_custkey::string, 10, '7') AS bank_inn, lpad(o_orderkey::string, 12, '3') AS principal_inn FROM orders")
def regex_bank_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank by its word, the principal by what is left."""
    rows = V.load(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('Банк-гарант ИНН ', lpad(cast(o_custkey AS string), 10, '7'), repeat(' .', 60), ' ИНН ', lpad(cast(o_orderkey AS string), 12, '3')) AS text")
    return X.with_roles(rows, "text", "r").select("id", "r.bank_inn", "r.principal_inn")


@query("SELECT doc_id, concat('files/', source, CASE WHEN n > 0 THEN concat('__', n) ELSE '' END, '.pdf') AS stored_path, concat('/data/', doc_id, '/', source, '.pdf') AS original_stored_path FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def portable_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11: paths of a bundle."""
    rows = V.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/data/"), "doc_id", F.lit("/"), "source", F.lit(".pdf")).alias("stored_path"), F.lit("").alias("stored_filename"))
    return T.bundle(rows, "").select(F.col("id").alias("doc_id"), "stored_path", "original_stored_path")


@query("SELECT doc_id, 2 AS at, 'new' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 1, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12, U4: updates as further rows, then the newest of each key."""
    old = V.load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("at"), F.lit("old").alias("state"))
    new = V.load(spark, sf_dir, "labels").select("doc_id", F.lit(2).alias("at"), F.lit("new").alias("state")).distinct()
    return R.latest(T.upsert_versions(old, new, "doc_id", "at"), "doc_id", "at", "state")


@query(r"SELECT page_id, regexp_extract(name, '^(.*)_[^_]*$', 1) AS file_key, name AS stem, page_id::int AS seed FROM (SELECT page_id, concat('g_', page_id, '_scan seed=', page_id) AS name FROM pages)")
def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14, SRC15."""
    path = F.concat(F.lit("/x/y.z/g_"), "page_id", F.lit("_scan seed="), "page_id", F.lit(".pdf"))
    key, stem = R.file_keys(path)
    return V.load(spark, sf_dir, "pages").select("page_id", key.alias("file_key"), stem.alias("stem"), R.seed_of(path).alias("seed"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('/seed/in/', doc_id) WHEN 1 THEN concat('/abs/', doc_id) ELSE '' END AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 3 <> 2")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, SRC4: resolved paths whose file isn't listed; empty paths name no file."""
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('in/', doc_id) WHEN 1 THEN concat('/abs/', doc_id) ELSE '' END")
    docs = V.load(spark, sf_dir, "documents").select("doc_id", T.resolved_path(path, "/seed/").alias("path"))
    listing = V.load(spark, sf_dir, "labels").select(F.concat(F.lit("file://"), T.resolved_path(path, "/seed/")).alias("path"))
    return T.missing_files(docs, "path", listing)


@query("SELECT event_id, coalesce((before IS NULL AND after = 'queued') OR (before = 'queued' AND after = 'running') OR (before = 'running' AND after IN ('succeeded', 'failed')) OR (before = 'failed' AND after = 'queued'), false) AS allowed FROM (SELECT event_id, [NULL, 'queued', 'running', 'failed', 'succeeded'][event_id % 5 + 1] AS before, ['queued', 'running', 'failed'][event_id % 3 + 1] AS after FROM events)")
def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between states of a job."""
    at = lambda names, n: F.element_at(F.array(*(F.lit(x).cast("string") for x in names)), (F.col("event_id") % n + 1).cast("int"))
    before, after = at([None, "queued", "running", "failed", "succeeded"], 5), at(["queued", "running", "failed"], 3)
    return V.load(spark, sf_dir, "events").select("event_id", allowed_step(before, after).alias("allowed"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")
def longest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VR7: the longest page that may be asked for; a longer one is refused."""
    rows = V.load(spark, sf_dir, "orders").select("o_orderkey")
    try:
        R.page(rows, [F.asc("o_orderkey")], 501)
    except ValueError:
        return R.page(rows, [F.asc("o_orderkey")], 500)
    raise AssertionError("a page of 501 rows was not refused")


ORACLE_WEIGHTED = ORACLES["weighted_accuracy"]


@query(ORACLE_WEIGHTED)
def weights_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: weights given as JSON."""
    weights = T.read_weights(json.dumps(Q.WEIGHTS))
    rows = E.group_metrics(E.field_sums(Q.diagnosed(spark, sf_dir), weights=weights), weights=weights)
    return rows.select("ocr_engine", "extractor", *(F.round(c, 6).alias(c) for c in ("weighted_accuracy", "weighted_doc_score")))


@query("SELECT cast(event_id AS string) AS id, ['wird', 'dict', 'plain'][event_id % 3 + 1] AS text, 1 AS n FROM events")
def recogniser_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a recogniser as a dict, below ``res``, or as attributes."""

    def read(parts):
        import types

        for part in parts:
            forms = [lambda t: {"res": {"rec_texts": [t], "rec_scores": [0.5]}}, lambda t: {"rec_texts": [t]}, lambda t: types.SimpleNamespace(texts=[t], scores=[1.0])]
            found = [L.recognised(forms[i % 3](("wird", "dict", "plain")[i % 3])) for i in part["event_id"]]
            yield part.assign(id=part["event_id"].astype(str), text=[f[0][0] for f in found], n=[len(f[0]) for f in found])[["id", "text", "n"]]

    return V.load(spark, sf_dir, "events").select("event_id").mapInPandas(read, "id string, text string, n int")
