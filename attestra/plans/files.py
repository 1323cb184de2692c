"""Registered queries of sources and sinks: what is written to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import structured as S
from attestra.functions.normalize import FIELDS
from attestra.operators import evaluation as E
from attestra.operators import records as R
from attestra.plans import queries as Q
from attestra.plans import views as V
from attestra.plans.registry import ORACLES, query
from attestra.plans.report import stored_diagnostics
from attestra.sources import tables as T
from attestra.operators.ranks import even_cuts
from attestra.streaming import states
from attestra.streaming.jobs import landing, resume


@query("SELECT doc_id AS id, source AS inn, lang, n_chars FROM documents ORDER BY sha256(concat('42:', cast(doc_id AS string))), doc_id LIMIT 200")
def seed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, SRC13, SNK3, W4: a sample as a CSV seed, read by name with its types; sampling is the feature."""
    path = T.shared_path(spark, "seed")
    sample = R.seeded_sample(V.load(spark, sf_dir, "documents"), 200, 42, "doc_id")
    T.write_seed(sample.select(F.col("doc_id").alias("id"), F.col("source").alias("inn"), "lang", "n_chars"), path)
    return T.read_dataset(spark, path, "id long, inn string, n_chars long").select("id", "inn", "lang", "n_chars")


@query("SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS state, o_totalprice AS total, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS batch FROM orders WHERE o_totalprice >= 1000")
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16, SNK12: orders through a database in two batches, the second one twice, read by ranges of near equal rows. The database is a file that driver and executors share."""
    url = f"sqlite:{T.shared_path(spark, 'database').removeprefix('file:')}"
    orders = V.load(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS customer", "o_orderstatus AS state", "o_totalprice AS total")
    for batch, rule in ((1, "state <> 'F'"), (2, "state = 'F' AND id % 2 = 0"), (2, "state = 'F'")):
        T.write_batch(orders.where(rule), url, "orders", batch)
    return T.read_table(spark, url, "orders", "id", parts=4 * spark.sparkContext.defaultParallelism).where("total >= 1000")


@query("SELECT event_id AS id, min(n) AS batch FROM (SELECT event_id, 1 AS n FROM events WHERE event_id % 4 < 2 UNION ALL SELECT event_id, 2 FROM events WHERE event_id % 4 <> 1 UNION ALL SELECT event_id, 3 FROM events) GROUP BY ALL")
def keyed_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, JN1, U1: three batches that overlap, the last one twice; each key stays as it came first."""
    path = T.shared_path(spark, "keyed")
    events = V.load(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    for n, rule in ((1, "id % 4 < 2"), (2, "id % 4 <> 1"), (3, "true"), (3, "true")):
        T.append_results(events.where(rule).withColumn("batch", F.lit(n)), path)
    return spark.read.parquet(path).select("id", "batch")


@query("SELECT doc_id AS id, md5(text) AS digest, length(text) AS chars, source AS inn FROM documents")
def quoted_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC13: whole texts with their line breaks inside quotes, read by byte ranges."""
    path = T.shared_path(spark, "quoted")
    docs = V.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("inn"))
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = T.read_dataset(spark, path, "id long, text string, inn string")
    return read.select("id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"), "inn")


@query(f"{Q.D} SELECT d.id, d.field, d.ok AS is_match, d.err AS error_type, round(d.sim, 6) AS edit_similarity, r.g AS gold_value, r.p AS pred_value FROM d JOIN (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, gold_{f} AS g, pred_{f} AS p FROM gp" for f in FIELDS) + ") r USING (id, field)")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SRC6, SNK1, SNK2, X18, P9, P10: results with the raw values as JSON, stored, added to, read again."""
    rows = Q.diagnosed(spark, sf_dir)
    rows = rows.withColumns({f"{side}_json": S.stored_json({f: F.col(f"{side}_{f}") for f in FIELDS}) for side in ("gold", "pred")})
    wide = E.wide(rows, "id", "ocr_engine", "extractor", "status", "gold_json", "pred_json")
    path = T.shared_path(spark, "results")
    T.write_results(wide.where("extractor = 'regex'"), path)
    T.append_results(wide, path, once=False)
    return E.from_wide(T.read_results(spark, path), "id", only=("is_match", "error_type", "edit_similarity")).select("id", "field", "is_match", "error_type", F.round("edit_similarity", 6).alias("edit_similarity"), "gold_value", "pred_value")


@query("SELECT 'r1' AS run_id, 200 AS sample_size, 42 AS seed_value, 'tesseract' AS ocr_engine, true AS named")
def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SNK4, SNK5: a run's metadata, and the form of a made run id."""
    path = T.shared_path(spark, "run")
    T.write_run(spark, path, {"run_id": "r1", "sample_size": 200, "seed_value": 42, "ocr_engine": "tesseract"})
    made = T.run_id(F.lit("tesseract"), F.lit("regex")).rlike(r"^\d{8}T\d{6}_tesseract_regex_[0-9a-f]{6}$")
    return T.read_run(spark, path, "r1").select("run_id", "sample_size", "seed_value", "ocr_engine", made.alias("named"))


@query("SELECT doc_id, concat('d', doc_id) AS stem, quality, toxic FROM labels")
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, SRC14, SNK6, SNK7: files of each document below its folder, found again by their folder's name."""
    root = T.shared_path(spark, "artifacts").removeprefix("file://")
    none = F.lit(None).cast("string")
    body = F.to_json(F.struct("doc_id", "quality", "toxic"))
    rows = V.load(spark, sf_dir, "labels").select(F.lit("labels").alias("guarantee_id"), F.concat(F.lit("d"), "doc_id").alias("stem"), none.alias("ocr_json"), none.alias("ocr_md"), body.alias("extraction_json"), none.alias("meta_json"))
    T.write_artifacts(rows, root)
    files = T.read_files(spark, root, "extraction.json")
    read = files.select(F.from_json(F.col("content").cast("string"), "doc_id long, quality long, toxic long").alias("r"), F.col("guarantee_id").alias("stem"))
    return read.select("r.doc_id", "stem", "r.quality", "r.toxic")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, JN3: ids from a file without a header, blank lines left out."""
    path = T.shared_path(spark, "ids")
    ids = V.load(spark, sf_dir, "labels").select(F.concat(F.lit(" "), F.col("doc_id")).alias("id"))
    ids.unionByName(spark.createDataFrame([("  ",)], "id string")).write.csv(path)
    docs = V.load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "source")
    return R.requested(docs, T.read_ids(spark, path)).select("doc_id", "source")


@query("SELECT c_name AS stem, c_custkey, c_acctbal FROM customer")
def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: one JSON file a document, below a folder of its own."""
    root = T.shared_path(spark, "truth").removeprefix("file://")
    rows = V.load(spark, sf_dir, "customer")
    T.write_artifacts(rows.select(F.lit("truth").alias("guarantee_id"), F.col("c_name").alias("stem"), F.to_json(F.struct("c_custkey", "c_acctbal")).alias("extraction_json")), root)
    files_ = T.read_files(spark, root, "extraction.json")
    read = files_.select(F.col("guarantee_id").alias("stem"), F.from_json(F.col("content").cast("string"), "c_custkey long, c_acctbal double").alias("r"))
    return read.select("stem", "r.c_custkey", "r.c_acctbal")


@query("SELECT page_id, i AS page_index, cast(least(strlen(html) - i * 1000, 1000) AS int) AS size FROM (SELECT page_id, html, unnest(range((strlen(html) + 999) // 1000)) AS i FROM pages)")
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, SRC9, SNK7: pages stored as source files of documents, read by the file source, cut into pages by an opener, each page through an engine."""
    root = T.shared_path(spark, "sources").removeprefix("file://")
    pages = V.load(spark, sf_dir, "pages").select(F.lit("pages").alias("guarantee_id"), F.concat(F.lit("p_"), "page_id").alias("stem"), F.encode("html", "UTF-8").alias("content"))
    T.write_artifacts(pages, root, copy_source=True)
    files = T.read_files(spark, root, "source.pdf")

    def opened(content: bytes, path: str) -> list[bytes]:
        return [content[at : at + 1000] for at in range(0, len(content), 1000)]

    found = T.pages(files, opened, lambda page, i: {"size": len(page)})
    key = F.regexp_extract("path", r"p_(\d+)/[^/]*$", 1).cast("long")
    return found.select(key.alias("page_id"), F.col("page_index").cast("long").alias("page_index"), F.get_json_object("page_json", "$.size").cast("int").alias("size"))


@query("SELECT doc_id, concat('d', doc_id) AS stem, quality FROM labels WHERE quality = 1")
def files_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, SRC10: of the artifacts of all labelled documents, those in the folders asked for; a filter on the folder reaches the listing."""
    root = T.shared_path(spark, "artifacts").removeprefix("file://")
    labels = V.load(spark, sf_dir, "labels")
    T.write_artifacts(labels.select(F.concat(F.lit("q"), "quality").alias("guarantee_id"), F.concat(F.lit("d"), "doc_id").alias("stem"), F.to_json(F.struct("doc_id", "quality")).alias("meta_json")), root)
    files_ = T.read_files(spark, root, "meta.json").where(F.col("path").contains("/q1/"))
    read = files_.select(F.from_json(F.col("content").cast("string"), "doc_id long, quality long").alias("r"), F.col("guarantee_id").alias("stem"))
    return read.select("r.doc_id", "stem", "r.quality")


@query("SELECT doc_id AS id, length(text) AS chars FROM documents")
def resume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work lands in a folder in two parts; each run does what is new, and a repeated id is done once."""
    work, out, mark = (T.shared_path(spark, n) for n in ("landing", "done", "mark"))
    docs = V.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    for part in (docs.where("source < 'src5'"), docs):
        part.select("id", "text").write.mode("append").parquet(work)
        resume(landing(spark, work, "id long, text string"), lambda batch: batch.select("id", F.length("text").cast("long").alias("chars")), out, mark).awaitTermination()
    return spark.read.schema("id long, chars long").parquet(out)


@query("SELECT status, count(*) AS n, round(avg(total_ms), 4) AS mean FROM (" + Q.GP + ") GROUP BY ALL")
def results_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: all runs below a folder of run partitions; columns that a run lacks are null."""
    path = T.shared_path(spark, "runs")
    rows = Q.gold_pred(spark, sf_dir).select("id", "status", "total_ms", "ocr_engine")
    for engine in ("tesseract", "paddleocr"):
        rows.where(F.col("ocr_engine") == engine).write.parquet(f"{path}/run_id={engine}")
    read = T.read_results(spark, path)
    return read.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_ms"), 4).alias("mean"))


_STEP = "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END"
_HOURS = 12


@query(f"""WITH RECURSIVE e AS (
    SELECT cast(user_id AS string) AS job, epoch_us(ts) AS t, {_STEP} AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
    SELECT DISTINCT job, 0::BIGINT AS n, NULL::string AS status, NULL::BIGINT AS since, 0 AS attempts, 0 AS refused, 0 AS timeouts FROM e
    UNION ALL
    SELECT job, n, CASE WHEN ok THEN step ELSE was END, CASE WHEN ok THEN t WHEN late THEN since + {_HOURS} * 3600000000 ELSE since END, attempts + (ok AND step = 'running')::int, refused + (NOT ok)::int, timeouts + late::int
    FROM (
        SELECT *, coalesce((was IS NULL AND step = 'queued') OR (was = 'queued' AND step = 'running') OR (was = 'running' AND step IN ('succeeded', 'failed')) OR (was = 'failed' AND step = 'queued'), false) AS ok
        FROM (SELECT e.job, e.n, e.t, e.step, s.since, attempts, refused, timeouts, x.late, CASE WHEN x.late THEN 'failed' ELSE status END AS was
              FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1, LATERAL (SELECT coalesce(s.status = 'running' AND e.t >= s.since + {_HOURS} * 3600000000, false) AS late) x))),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1),
z AS (SELECT *, coalesce(status = 'running' AND (since + {_HOURS} * 3600000000 + 999) // 1000 <= (SELECT max(t) // 1000 FROM e), false) AS late FROM f)
SELECT job, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN since + {_HOURS} * 3600000000 ELSE since END AS since, attempts::BIGINT AS attempts, refused::BIGINT AS refused, (timeouts + late::int)::BIGINT AS timeouts FROM z""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, events as steps, twelve hours as the time for an answer. The steps land in three parts, and each run goes on from the states of the one before."""
    work, out, mark = (T.shared_path(spark, n) for n in ("steps", "job-log", "job-mark"))
    steps = V.load(spark, sf_dir, "events").selectExpr("cast(user_id AS string) AS job", "event_id AS id", "unix_micros(cast(ts AS timestamp)) AS at", f"{_STEP} AS step")
    cuts = [int(c) for c in even_cuts(steps, "at", 3)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = steps if low is None else steps.where(F.col("at") >= low)
        (part if high is None else part.where(F.col("at") < high)).write.mode("append").parquet(work)
        states.follow_jobs(landing(spark, work, states.STEPS, files_per_trigger=100_000), out, mark, _HOURS * 3600).awaitTermination()
    return states.job_states(spark.read.schema(states.LOG).parquet(out)).withColumn("attempts", F.col("attempts").cast("long"))


@query("SELECT sum(n)::BIGINT AS rows, max(n)::BIGINT AS last, 2::BIGINT AS runs FROM (SELECT count(*) AS n FROM documents WHERE source < 'src5' UNION ALL SELECT count(*) FROM documents WHERE NOT source < 'src5') t")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: progress rows of two runs over a folder: rows taken in all, in the larger run, and runs with rows."""
    work, out, mark, log = (T.shared_path(spark, n) for n in ("landing", "done", "mark", "progress"))
    docs = V.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    for run, part in enumerate((docs.where("source < 'src5'"), docs.where("NOT source < 'src5'"))):
        part.select("id").write.mode("append").parquet(work)
        stream = resume(landing(spark, work, "id long", files_per_trigger=100_000), lambda batch: batch, out, mark)
        stream.awaitTermination()
        seen = [(run, p["numInputRows"], p["batchDuration"]) for p in stream.recentProgress]
        spark.createDataFrame(seen, "run int, rows long, ms long").coalesce(1).write.mode("append").parquet(log)
    runs = spark.read.parquet(log).groupBy("run").agg(F.sum("rows").alias("rows")).where("rows > 0")
    return runs.agg(F.sum("rows").alias("rows"), F.max("rows").alias("last"), F.count(F.lit(1)).alias("runs"))


@query(ORACLES["micro_macro_accuracy"])
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: the rows behind the report, from results as they are stored."""
    path = T.shared_path(spark, "results")
    rows = Q.diagnosed(spark, sf_dir)
    rows = rows.withColumns({f"{side}_json": S.stored_json({f: F.col(f"{side}_{f}") for f in FIELDS}) for side in ("gold", "pred")})
    T.write_results(E.wide(rows, "id", "ocr_engine", "extractor", "status", "ocr_ms", "extract_ms", "total_ms", "gold_json", "pred_json"), path)
    sums = E.field_sums(stored_diagnostics(E.succeeded(T.read_results(spark, path)), 0.01))
    return E.group_metrics(sums).select("ocr_engine", "extractor", *(F.round(c, 6).alias(c) for c in ("micro_accuracy", "macro_accuracy")))
