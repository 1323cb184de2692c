"""Operators, sources, streams and the report on small tables."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions.normalize import FIELDS
from attestra.operators import evaluation as E
from attestra.operators import layout as L
from attestra.operators import records as R
from attestra.operators.extraction import extract_by_model, extract_by_patterns
from attestra.plans import queries as Q
from attestra.plans import report, views
from attestra.sources import schemas, tables
from attestra.streaming import jobs as streams


@pytest.fixture(scope="module")
def diagnosed(spark, data):
    return Q.diagnosed(spark, data).cache()


def test_aggregate_invariants(diagnosed):
    sums = E.field_sums(diagnosed, weights=Q.WEIGHTS).cache()
    fields, groups = E.field_metrics(sums).toPandas(), {(r.ocr_engine, r.extractor): r for r in E.group_metrics(sums, weights=Q.WEIGHTS).collect()}
    assert len(groups) == 4 and len(fields) == 32
    tall = E.tall(diagnosed, "id", "ocr_engine", "extractor").toPandas()
    for key, own in fields.groupby(["ocr_engine", "extractor"]):
        g, rows = groups[key], tall[(tall.ocr_engine == key[0]) & (tall.extractor == key[1])]
        assert g.micro_accuracy == pytest.approx(g.macro_accuracy)
        assert g.weighted_accuracy == pytest.approx(g.weighted_doc_score)
        assert g.correct + g.missing + g.wrong + g.extra == 8 * g.n_docs == len(rows)
        assert g.doc_em <= own.accuracy.min()
        for _, f in own.iterrows():
            of = rows[rows.field == f.field]
            assert f.tp + f.fn == of.gold_value.notna().sum()
            assert f.tp + f.fp == of.pred_value.notna().sum()


def test_slot_counts(spark):
    rows = spark.createDataFrame([("a", "b", k) for k in ("correct", "missing", "extra", "wrong")], "ocr_engine string, extractor string, error_type string")
    for f in FIELDS:
        d = F.struct((F.col("error_type") == "correct").alias("is_match"), "error_type", F.lit(None).cast("double").alias("edit_similarity"), F.lit(None).cast("double").alias("digit_acc"), F.lit(None).cast("double").alias("abs_error"), F.lit(None).cast("boolean").alias("within_tolerance"), (F.col("error_type") != "extra").alias("has_gold"))
        rows = rows.withColumn(f"d_{f}", d)
    one = E.field_metrics(E.field_sums(rows)).where("field = 'ikz'").first()
    assert (one.tp, one.fp, one.fn, one.precision) == (1, 2, 2, pytest.approx(1 / 3))
    less = E.field_metrics(E.field_sums(rows, wrong_counts_as_fn=False)).where("field = 'ikz'").first()
    assert (less.tp, less.fp, less.fn) == (1, 2, 1)
    assert one.avg_edit_sim is None
    with_null = rows.withColumn("extractor", F.lit(None).cast("string"))
    assert E.field_sums(with_null).count() == 0


def test_percentiles(spark):
    values = [5.0, 1.0, 9.0, 2.0, 2.5, 100.0]
    rows = spark.createDataFrame([("e", "x", v, None, v) for v in values], "ocr_engine string, extractor string, ocr_ms double, extract_ms double, total_ms double")
    got = {r.stage: r for r in E.latency_stats(rows).collect()}
    assert [got["ocr_ms"].median, got["ocr_ms"].p95, got["ocr_ms"].p99] == pytest.approx(list(np.percentile(values, [50, 95, 99])))
    assert got["extract_ms"].mean == 0.0


def test_missing_columns_count_as_missing(spark):
    rows = spark.createDataFrame([(1, True, '{"sum": "5"}', '{"sum": "5,0"}')], "id long, match_ikz boolean, gold_json string, pred_json string")
    got = {r.field: r for r in E.from_wide(rows, "id").collect()}
    assert got["ikz"].is_match and got["currency"].error_type == "missing" and not got["currency"].is_match
    assert got["sum"].within_tolerance is True and got["ikz"].within_tolerance is None


def test_plain_equality_skips_and_pairs(spark):
    gold = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v1")], "id long, x string, schema_version string")
    pred = spark.createDataFrame([(1, "a", "v2")], "id long, x string, schema_version string")
    assert [tuple(r) for r in E.equal_fields(gold, pred, "id").collect()] == [(1, "x", True)]


WORDS = [(0, 0, "b", 1, 0, 50, 5, 20, 10, 90.0), (0, 1, "a", 1, 0, 10, 6, 20, 10, 80.0), (0, 2, " ", 1, 0, 0, 0, 1, 1, 5.0), (0, 3, "low", 1, 1, 10, 20, 30, 10, -1.0), (0, 4, "top", 2, 0, 0, 0, 9, 4, 100.0)]


def test_layout(spark):
    words = spark.createDataFrame(WORDS, "page long, ord int, text string, block_num int, line_num int, left int, top int, width int, height int, conf double")
    got = {r.block_num: r for r in L.blocks(words, "page").collect()}
    assert (got[1].text, got[1].bbox, got[1].confidence) == ("b a\nlow", [10, 5, 70, 30], round((0.9 + 0.8 + 0) / 3, 4))
    pages = L.blocks(words, "page").withColumn("doc", F.lit("d"))
    assert L.page_markdown(pages, "doc", "page").first().markdown == "# Page 1\n\ntop\n\nb a\nlow\n"
    two = pages.unionByName(pages.withColumn("page", F.lit(1).cast("long")))
    assert "low\n\n# Page 2" in L.page_markdown(two, "doc", "page").first().markdown
    assert "low\n\n\n# Page 2" in L.page_markdown(two, "doc", "page", blank_after_page=True).first().markdown


def test_polygon_and_threshold(spark):
    rows = spark.createDataFrame([([[1.5, 2.0], [9.0, 1.0], [4.0, 7.9]], None), (None, [1.0, 2.0, 3.0, 4.0]), (None, None)], "p array<array<double>>, b array<double>")
    assert [r[0] for r in rows.select(L.polygon_bbox(F.col("p"), F.col("b"))).collect()] == [[1, 1, 9, 7], [1, 2, 3, 4], [0, 0, 0, 0]]
    rng = np.random.default_rng(1)
    grey = np.concatenate([rng.normal(60, 10, 400), rng.normal(180, 20, 300)]).clip(0, 255).astype(int)
    count = np.bincount(grey, minlength=256).astype(float)
    c, s = np.cumsum(count), np.cumsum(count * np.arange(256))
    with np.errstate(all="ignore"):
        between = c / c[-1] * (1 - c / c[-1]) * (np.nan_to_num(s / c) - np.nan_to_num((s[-1] - s) / (c[-1] - c))) ** 2
    pixels = spark.createDataFrame([("i", int(v)) for v in grey], "image string, v int")
    assert L.otsu_threshold(pixels, "image", "v").first().threshold == int(np.argmax(between))


def test_joins_and_sets(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "id long, x string"), spark.createDataFrame([(2, "n"), (3, "n"), (3, "m")], "id long, x string")
    assert sorted(map(tuple, R.append_keep_first(old, new).collect())) == [(1, "o"), (2, "o"), (3, "m"), (3, "n")]
    assert [r.id for r in R.requested(new, old).collect()] == [2]
    assert {(r.id, r.x) for r in R.pending(new, old).collect()} == {(3, "n"), (3, "m")}
    diags = spark.createDataFrame([(1, "a", True, "correct")], "id long, field string, is_match boolean, error_type string")
    got = {r.field: (r.is_match, r.error_type) for r in R.with_missing_fields(diags, ["id"], ["a", "b"]).collect()}
    assert got == {"a": (True, "correct"), "b": (False, "missing")}


def test_latest_versions_children(spark):
    log = spark.createDataFrame([("j", 1, 10, "a"), ("j", 2, 10, "b"), ("j", 3, 5, "c"), ("k", 4, 1, None)], "job string, id long, at long, payload string")
    assert {r.job: r.id for r in R.latest(log, "job", "at", "id").collect()} == {"j": 2, "k": 4}
    got = {r.id: (r.version, r.previous_payload) for r in R.versions(log, "job", "at", "id", "payload").collect()}
    assert got == {3: (1, None), 1: (2, "c"), 2: (3, "a"), 4: (1, None)}
    jobs = spark.createDataFrame([("j",), ("z",)], "job string")
    children = {r.job: r for r in R.with_children(jobs, "job", {"artifact": jobs.where("job = 'j'").withColumn("p", F.lit(1))}, {"log": log}).collect()}
    assert len(children["j"].log) == 3 and children["z"].log == [] and children["z"].artifact is None and children["j"].artifact.p == 1


def test_pages_and_samples(spark):
    rows = spark.range(100).withColumn("s", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    assert [r.id for r in R.page(rows, [F.desc("id")], 3, 2, s="x").collect()] == [94, 92, 90]
    assert R.page(rows, [F.desc("id")], 3, 0, s=None).count() == 3
    for bad in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError, match="limit"):
            R.page(rows, [F.desc("id")], *bad)
    one = [r.id for r in R.seeded_sample(rows, 10, 42, "id").collect()]
    assert one == [r.id for r in R.seeded_sample(rows.repartition(7), 10, 42, "id").collect()] != [r.id for r in R.seeded_sample(rows, 10, 43, "id").collect()]
    assert R.seeded_sample(rows, 1000, 1, "id").count() == 100
    assert [r.id for r in R.by_id(rows, 5).collect()] == [5]
    parts = {r.batch: r.n for r in R.batches(rows, "id", 32).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert parts == {0: 32, 1: 32, 2: 32, 3: 4}


def test_names_and_paths(spark):
    rows = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "a.pdf"), (4, "a__1.pdf"), (5, "b"), (6, "b")], "id long, n string")
    got = {r.id: r.unique_name for r in R.unique_names(rows, "n", "id").collect()}
    assert got == {1: "a.pdf", 2: "a__1.pdf", 3: "a__2.pdf", 4: "a__1__1.pdf", 5: "b", 6: "b__1"}
    rows = spark.createDataFrame([(1, "a.pdf"), (2, "a__1.pdf"), (3, "a__2.pdf"), (4, "a.pdf")], "id long, n string")
    assert {r.id: r.unique_name for r in R.unique_names(rows, "n", "id").collect()} == {1: "a.pdf", 2: "a__1.pdf", 3: "a__2.pdf", 4: "a__3.pdf"}
    files = spark.createDataFrame([("/x/1589112_1.pdf",), ("a_b_c.PDF",), ("plain",), ("x.seed=42.csv",)], "p string")
    key, stem = R.file_keys(F.col("p"))
    assert [tuple(r) for r in files.select(key, stem, R.seed_of(F.col("p")), R.allowed_type(F.col("p"))).collect()] == [
        ("1589112", "1589112_1", None, True), ("a_b", "a_b_c", None, True), ("plain", "plain", None, False), ("x.seed=42", "x.seed=42", 42, False),
    ]
    paths = spark.createDataFrame([("/data/in/a",), ("/data/input",), ("/data/in",), ("/data/in/../x",)], "p string")
    assert [r[0] for r in paths.select(R.under_roots(F.col("p"), ["/data/in/"])).collect()] == [True, False, True, False]
    got = spark.createDataFrame([(["a", "b", "c", "d"], "x" * 600, "m" * 3000)], "e array<string>, t string, m string").select(R.error_message(F.col("e")), F.length(R.trace_tail(F.col("t"))), F.length(R.stored_message(F.col("m")))).first()
    assert tuple(got) == ("a; b; c", 500, 2000)
    pace = spark.createDataFrame([(100.0, 10, 30), (5.0, 0, 3)], "e double, n int, t int").select(R.remaining_ms(F.col("e"), F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in pace] == [200.0, None]


def test_dataset_and_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿id,stored_path,pcpl_inn,sum,extra\n1,a.pdf,007,\"1,5\",x\n2,/abs/b.pdf,,3,y\n", encoding="utf-8")
    rows = tables.read_dataset(spark, str(tmp_path / "d.csv"))
    got = rows.withColumn("full", tables.resolved_path(F.col("stored_path"), "/root/x/")).orderBy("id").collect()
    assert [(r.id, r.pcpl_inn, r["sum"], r.extra, r.full, r.ikz) for r in got] == [(1, "007", "1,5", "x", "/root/x/a.pdf", None), (2, None, "3", "y", "/abs/b.pdf", None)]
    for folder, name in (("11", "11_1.pdf"), ("12", "12_1.pdf"), ("12", "note.txt")):
        (tmp_path / "raw" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / folder / name).write_bytes(b"two\npages")
    (tmp_path / "ids.csv").write_text("12\n\n  \n99\n")
    ids = tables.read_ids(spark, str(tmp_path / "ids.csv"))
    files = tables.read_files(spark, str(tmp_path / "raw"), ids=ids)
    assert [(r.guarantee_id, r.file_key, r.stem) for r in files.collect()] == [("12", "12", "12_1")]
    assert tables.read_files(spark, str(tmp_path / "raw")).count() == 2
    pages = tables.pages(files, lambda content, path: content.decode().split("\n"), lambda image, i: {"text": image}).orderBy("page_index").collect()
    assert [(r.page_index, json.loads(r.page_json)["text"]) for r in pages] == [(0, "two"), (1, "pages")]
    broken = tables.pages(files, lambda content, path: 1 / 0, lambda image, i: {}).collect()
    assert broken[0].page_index is None and "division" in broken[0].error
    listed = tables.read_files(spark, str(tmp_path / "raw")).select("path")
    seeds = spark.createDataFrame([(1, str(tmp_path / "raw/11/11_1.pdf")), (2, "/nowhere.pdf"), (3, "")], "id long, stored_path string")
    assert [r.id for r in tables.missing_files(seeds, "stored_path", listed).collect()] == [2]
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "12_1.json").write_text('{"amount": 5}')
    assert [tuple(r) for r in tables.read_truth(spark, str(tmp_path / "gt"), "amount double").collect()] == [(5.0, "12_1")]
    (tmp_path / "w.json").write_text('{"sum": 2}')
    assert tables.read_weights(str(tmp_path / "w.json")) == {"sum": 2.0} == tables.read_weights('{"sum": 2}')


def results(spark, n, engine="tesseract"):
    rows = spark.range(n).select(
        "id", F.lit("p").alias("stored_path"), F.lit(engine).alias("ocr_engine"), F.lit("regex").alias("extractor"), F.when(F.col("id") == 0, "failed").otherwise("succeeded").alias("status"),
        *(F.lit(float(i)).alias(s) for i, s in enumerate(("ocr_ms", "extract_ms", "total_ms"))), F.lit('{"sum": "10", "ikz": "1"}').alias("gold_json"), F.lit('{"sum": "10.2", "ikz": "1"}').alias("pred_json"),
        F.lit(True).alias("match_ikz"), F.lit("correct").alias("error_type_ikz"), F.lit(False).alias("match_sum"), F.lit("wrong").alias("error_type_sum"), F.lit(0.2).alias("abs_error_sum"), F.lit(False).alias("within_tol_sum"),
    )
    return rows


def test_runs_and_report(spark, tmp_path):
    out = str(tmp_path / "runs")
    assert tables.read_results(spark, out).count() == 0
    tables.append_results(results(spark, 4), f"{out}/run_id=a")
    tables.append_results(results(spark, 6), f"{out}/run_id=a")
    tables.write_results(results(spark, 3, "paddleocr"), f"{out}/run_id=b")
    stored = tables.read_results(spark, out)
    assert {r.run_id: r["count"] for r in stored.groupBy("run_id").count().collect()} == {"a": 6, "b": 3}
    tables.write_run(spark, f"{out}-meta", {"run_id": "a", "sample_size": 6, "seed_value": 42, "machine": {"system": "s"}})
    run = tables.read_run(spark, f"{out}-meta", "a").first()
    assert (run.sample_size, run.machine.system) == (6, "s") and tables.read_run(spark, f"{out}-none", "q").first().run_id == "q"
    metrics = report.compute(stored, weights={"ikz": 1.0, "sum": 1.0})
    t = metrics["tesseract+regex"]
    assert (t["n_docs"], t["n_succeeded"], t["n_failed"]) == (6, 5, 1)
    assert t["field_accuracy"]["ikz"] == 1.0 and t["field_accuracy"]["currency"] == 0.0 and t["micro_accuracy"] == pytest.approx(1 / 8)
    assert t["error_counts"] == {"correct": 5, "missing": 30, "wrong": 5, "extra": 0}
    assert t["amount_mae"] == pytest.approx(0.2) and t["amount_tolerance_acc"] == 0.0 and t["weighted_accuracy"] == 0.5
    assert report.compute(stored, tolerance=0.5)["tesseract+regex"]["amount_tolerance_acc"] == 1.0
    text = report.render(metrics, ["a", "b"], run.asDict())
    assert "## paddleocr+regex" in text and "| **Micro** | **12.5%** |" in text and "## Comparison Summary" in text and "- Seed: 42" in text
    report.write(str(tmp_path / "rep"), metrics, text)
    assert json.loads((tmp_path / "rep/metrics.json").read_text())["tesseract+regex"]["n_docs"] == 6
    assert report.render({}, []) == "# No results found\n"
    assert report.compute(stored.limit(0)) == {}
    name = spark.range(1).select(tables.run_id(F.lit("e"), F.lit("x")).alias("n")).first().n
    assert len(name.split("_")) == 4 and len(name.split("_")[3]) == 6


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("g", "g_1", "{}", "# Page", None, "{}", bytearray(b"pdf"))], "guarantee_id string, stem string, ocr_json string, ocr_md string, extraction_json string, meta_json string, content binary")
    tables.write_artifacts(rows, str(tmp_path / "out"), copy_source=True)
    assert sorted(os.listdir(tmp_path / "out/g/g_1")) == ["meta.json", "ocr.json", "ocr.md", "source.pdf"]
    tables.write_seed(spark.createDataFrame([(1, "007")], "id int, inn string"), str(tmp_path / "seed"))
    assert spark.read.csv(str(tmp_path / "seed"), header=True).first().inn == "007"
    done = spark.createDataFrame([("a", True, None), ("b", False, "bad")], "path string, ok boolean, error string")
    totals, failures = tables.manifest(done)
    assert tuple(totals.first()) == (2, 1, 1) and [tuple(r) for r in failures.collect()] == [("b", "bad")]
    legacy = spark.createDataFrame([(True, False, 9.0), (False, True, 10.0), (False, False, 20.0)], "skipped boolean, matched boolean, latency_ms double")
    assert tuple(tables.legacy_report(legacy).first()) == (3, 1, 1, 15.0)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.pdf").write_text("1")
    seed = spark.createDataFrame([(1, str(tmp_path / "src/a.pdf"), None), (2, str(tmp_path / "src/a.pdf"), "")], "id long, stored_path string, stored_filename string")
    packed = tables.bundle(seed, str(tmp_path / "bundle"))
    tables.write_bundle(packed, str(tmp_path / "bundle"), "zip")
    assert sorted(os.listdir(tmp_path / "bundle/files")) == ["a.pdf", "a__1.pdf"] and (tmp_path / "bundle.zip").exists()
    both = tables.upsert_versions(done.withColumn("at", F.lit(1)), done.where("path = 'b'").withColumn("ok", F.lit(True)).withColumn("at", F.lit(2)), "path", "at")
    assert {r.path: r.ok for r in R.latest(both, "path", "at", "path").collect()} == {"a": True, "b": True}


def test_extraction_with_retries(spark, tmp_path):
    folder = str(tmp_path)

    def make():  # defined here, so that workers get it by value
        def generate(system: str, question: str, schema: dict) -> str:
            """A model whose answers depend on how often it was asked about a text."""
            name = os.path.join(folder, question.split("---\n")[1].split("\n---")[0])
            with open(name, "a") as f:
                f.write("x")
            asked = os.path.getsize(name)
            if "boom" in name:
                raise RuntimeError("no model")
            if "never" in name:
                return "garbage"
            return '{"principal_inn": "1234567890"}' if "good" in name or asked > 1 else '{"principal_inn": "12"}'

        return generate

    docs = spark.createDataFrame([("good", 1), ("later", 2), ("never", 3), ("boom", 4)], "text string, id int").repartition(2)
    got = {r.text: r for r in extract_by_model(docs, make).collect()}
    assert {k: (r.status, r.attempts) for k, r in got.items()} == {"good": ("succeeded", 1), "later": ("succeeded", 2), "never": ("failed_validation", 3), "boom": ("failed_runtime", 1)}
    assert got["good"].record.principal_inn == "1234567890" and got["never"].raw == "garbage" and got["boom"].errors == ["no model"]
    assert {n: os.path.getsize(tmp_path / n) for n in ("good", "later", "never", "boom")} == {"good": 1, "later": 2, "never": 3, "boom": 1}
    assert extract_by_patterns(docs).where("record.currency IS NULL").count() == 4


def test_resumed_stream(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.range(3).write.parquet(src)
    seen = []
    listener = streams.Progress(lambda total, n, ms: seen.append((total, n)))
    spark.streams.addListener(listener)
    for _ in range(2):
        streams.resume(streams.landing(spark, src, "id long"), lambda b: b.withColumn("x", F.col("id") * 2), out, check).awaitTermination(120)
        spark.range(2, 5).write.mode("append").parquet(src)
    streams.resume(streams.landing(spark, src, "id long"), lambda b: b.withColumn("x", F.col("id") * 2), out, check).awaitTermination(120)
    spark.streams.removeListener(listener)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    steps = spark.createDataFrame([(None, "queued"), ("queued", "running"), ("running", "queued"), ("succeeded", "running"), ("running", None)], "a string, b string")
    assert [r[0] for r in steps.select(streams.allowed_step(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_windows_of_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = streams.event_windows(streams.landing(spark, str(tmp_path / "events"), events.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = streams.event_windows(events)
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(batch)


def test_views_have_all_kinds_of_errors(diagnosed):
    kinds = {r.error_type for r in E.tall(diagnosed, "id").select("error_type").distinct().collect()}
    assert kinds == {"correct", "missing", "wrong", "extra"}
    assert set(views.GOLD_PRED) >= {f"gold_{f}" for f in FIELDS}
    assert "match_ikz boolean" in schemas.RESULTS


def test_answers_of_many_rows_are_not_broadcast(spark):
    """Beside a wide record a few columns of a written table look small, however many rows there are."""
    docs = spark.range(50).selectExpr("id", "concat('t', id) AS text")
    found = extract_by_model(docs, lambda: lambda system, question, schema: "{}" if "t7" in question else "no", retries=1, key="id").select("id", "status", "attempts")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50


@pytest.mark.parametrize("name", ["layout_blocks", "layout_markdown"])
def test_words_are_grouped_where_their_document_is(spark, data, name):
    """Documents are shuffled once, before they become rows of words."""
    plan = getattr(Q, name)(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Generate") < plan.index("Exchange")  # the plan is printed from the end


def test_mentions_are_looked_for_once_however_many_roles_are_read(spark, data):
    plan = Q.regex_inn_roles(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\G(.*?)") == 2  # the gaps and the INNs


def test_small_tables_are_dealt_in_parts_that_grow_with_their_files(spark, data):
    one = views.load(spark, data, "orders")
    assert views.spread(one).rdd.getNumPartitions() == 32 * one.rdd.getNumPartitions()


def test_missing_fields_compute_no_measures(spark, data):
    """Only what is returned is computed before the rows are exploded and packed."""
    from attestra.plans.queries import missing_fields

    plan = missing_fields(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "zip_with" not in plan


def test_stored_values_are_not_parsed_inside_the_generator(spark):
    rows = spark.createDataFrame([("d", '{"sum": "1,5", "ikz": "12"}', '{"sum": "1.5"}', True)], "id string, gold_json string, pred_json string, match_sum boolean")
    tall = E.from_wide(rows, "id", only=("is_match", "error_type"))
    plan = tall._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "Generate explode" in line] and not any("Generate" in line and "from_json" in line for line in plan)
    got = {r.field: (r.gold_value, r.pred_value, r.is_match, r.error_type, r.has_gold) for r in tall.collect()}
    assert got["sum"] == ("1,5", "1.5", True, "missing", True) and got["ikz"] == ("12", None, False, "missing", True) and len(got) == 8
    assert tall.columns == ["id", "field", "pred_value", "gold_value", "is_match", "error_type", "has_gold"]


def test_diagnoses_are_not_computed_in_the_scan(spark, data):
    """No filter asks for the size of what is exploded: it would compute all diagnoses of a table in the tasks that read it, before it is dealt, and again after."""
    tall = Q.tall_results(spark, data)
    plan = tall._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Generate explode" in line for line in plan)
    assert not any("size(" in line for line in plan if "Filter" in line)
    assert sum("levenshtein" in line for line in plan) == 1 and not any("zip_with" in line for line in plan)
