"""The evaluation report: metrics of runs by configuration, as a dictionary and as Markdown (A17, N13, SNK8).

All figures come from three aggregations, each run once; the driver only sees a few rows for each
configuration and renders them.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.metrics import ERROR_TYPES, within_tolerance
from attestra.functions.normalize import FIELDS, amount
from attestra.operators import evaluation as E

DASH = "—"


def percent(x: float | None) -> str:
    return DASH if x is None else f"{x * 100:.1f}%"


def fixed(x: float | None, places: int) -> str:
    return DASH if x is None else f"{x:.{places}f}"


def stored_diagnostics(results: DataFrame, tolerance: float) -> DataFrame:
    """Structs of each field from the stored result layout, without bringing a document's fields together by a shuffle."""
    columns = []
    for f in FIELDS:
        have = set(results.columns)
        get = lambda m, kind, f=f, have=have: F.col(f"{m}_{f}").cast(kind) if f"{m}_{f}" in have else F.lit(None).cast(kind)
        gold = F.try_element_at(F.from_json("gold_json", "map<string,string>"), F.lit(f))
        pred = F.try_element_at(F.from_json("pred_json", "map<string,string>"), F.lit(f))
        within = get("within_tol", "boolean")
        if f == "sum":
            g, p = amount(gold), amount(pred)
            # The tolerance asked for applies where values are stored; the stored flag where they aren't.
            within = F.when(g.isNotNull() | p.isNotNull(), within_tolerance(p, g, tolerance)).otherwise(within)
        columns.append(
            F.struct(
                F.coalesce(get("match", "boolean"), F.lit(False)).alias("is_match"), F.coalesce(get("error_type", "string"), F.lit("missing")).alias("error_type"),
                E.finite(get("edit_sim", "double")).alias("edit_similarity"), E.finite(get("digit_acc", "double")).alias("digit_acc"),
                E.finite(get("abs_error", "double")).alias("abs_error"), within.alias("within_tolerance"), gold.isNotNull().alias("has_gold"),
            ).alias(f"d_{f}")
        )
    return results.select(*E.GROUP, *E.STAGES, *columns)


def compute(results: DataFrame, weights: dict[str, float] | None = None, wrong_counts_as_fn: bool = True, tolerance: float = 0.01) -> dict[str, dict]:
    """Metrics of each configuration with results, by ``engine+extractor`` in order."""
    counts = {(r["ocr_engine"], r["extractor"]): r for r in E.status_counts(results).collect()}
    rows = stored_diagnostics(E.succeeded(results), tolerance)
    sums = E.field_sums(rows, wrong_counts_as_fn=wrong_counts_as_fn, weights=weights)
    sums = results.sparkSession.createDataFrame(sums.collect(), sums.schema)  # a row for each configuration, used twice
    fields = {}
    for r in E.field_metrics(sums).collect():
        fields.setdefault((r["ocr_engine"], r["extractor"]), {})[r["field"]] = r
    groups = {(r["ocr_engine"], r["extractor"]): r for r in E.group_metrics(sums, weights=weights).collect()}
    latency: dict = {}
    for r in E.latency_stats(rows).collect():
        latency.setdefault((r["ocr_engine"], r["extractor"]), {})[r["stage"]] = {k: r[k] for k in ("median", "p95", "p99", "mean")}
    out = {}
    for key in sorted(counts):
        g, own = groups.get(key), fields.get(key, {})
        value = lambda name, empty, g=g: g[name] if g is not None else empty
        out["+".join(key)] = {
            "n_docs": counts[key]["total"], "n_succeeded": counts[key]["succeeded"], "n_failed": counts[key]["failed"],
            "field_accuracy": {f: own[f]["accuracy"] if f in own else 0.0 for f in FIELDS},
            "slots": {f: {k: own[f][k] if f in own else 0 for k in ("tp", "fp", "fn", "precision", "recall", "f1")} for f in FIELDS},
            **{m: value(m, 0.0) for m in ("micro_accuracy", "macro_accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_f1", "doc_em")},
            "avg_edit_sim": {f: own[f]["avg_edit_sim"] for f in FIELDS if f in own and own[f]["avg_edit_sim"] is not None},
            "avg_digit_acc": {f: own[f]["avg_digit_acc"] for f in FIELDS if f in own and own[f]["avg_digit_acc"] is not None},
            "amount_mae": value("amount_mae", None), "amount_tolerance_acc": value("amount_tolerance_acc", None),
            "error_counts": {e: value(e, 0) for e in ERROR_TYPES},
            **{f"latency_{s}": latency.get(key, {}).get(s, dict.fromkeys(("median", "p95", "p99", "mean"), 0.0)) for s in E.STAGES},
            "weighted_accuracy": value("weighted_accuracy", None) if weights else None, "weighted_doc_score_mean": value("weighted_doc_score", None) if weights else None,
        }
    return out


def table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows), ""]


def render(metrics: dict[str, dict], run_ids: list[str], run: dict | None = None, tolerance: float = 0.01) -> str:
    if not metrics:
        return "# No results found\n"
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    run = run or {}
    out = ["# Validation Report", "", f"Generated: {now}", "", f"Run IDs: {', '.join(run_ids)}", "", f"- Sample size: {run.get('sample_size', '?')}", f"- Seed: {run.get('seed_value', '?')}", f"- LLM model: {run.get('llm_model') or DASH}", ""]
    for key, m in metrics.items():
        out += [f"## {key}", "", f"Documents: {m['n_docs']} total, {m['n_succeeded']} succeeded, {m['n_failed']} failed", "", "### Field-Level Exact-Match Accuracy", ""]
        out += table(["Field", "Accuracy"], [[f, percent(a)] for f, a in m["field_accuracy"].items()] + [["**Micro**", f"**{percent(m['micro_accuracy'])}**"], ["**Macro**", f"**{percent(m['macro_accuracy'])}**"]])
        out += ["### Slot-Filling Precision / Recall / F1", ""]
        slots = [[f, *(str(s[k]) for k in ("tp", "fp", "fn")), *(fixed(s[k], 3) for k in ("precision", "recall", "f1"))] for f, s in m["slots"].items()]
        micro = ["**Micro**", *(str(sum(s[k] for s in m["slots"].values())) for k in ("tp", "fp", "fn")), *(fixed(m[f"micro_{k}"], 3) for k in ("precision", "recall", "f1"))]
        out += table(["Field", "TP", "FP", "FN", "Precision", "Recall", "F1"], [*slots, micro, ["**Macro F1**", "", "", "", "", "", f"**{fixed(m['macro_f1'], 3)}**"]])
        out += [f"### Document-Level Exact Match (Doc-EM): **{percent(m['doc_em'])}**", ""]
        for name, title, head in (("avg_edit_sim", "Normalised Edit Similarity (ANLS-style)", "Avg Similarity"), ("avg_digit_acc", "Digit-Level Accuracy", "Avg Digit Accuracy")):
            if m[name]:
                out += [f"### {title}", "", *table(["Field", head], [[f, fixed(v, 3)] for f, v in m[name].items()])]
        if m["amount_mae"] is not None:
            out += ["### Amount Metrics", "", f"- MAE: {fixed(m['amount_mae'], 3)}", f"- Tolerance accuracy (eps={tolerance}): {percent(m['amount_tolerance_acc'] or 0)}", ""]
        out += ["### Error Breakdown", "", *table(["Type", "Count"], [[e, str(n)] for e, n in m["error_counts"].items()])]
        stages = (("OCR", "latency_ocr_ms"), ("Extraction", "latency_extract_ms"), ("Total", "latency_total_ms"))
        out += ["### Latency (ms)", "", *table(["Stage", "Median", "P95", "P99", "Mean"], [[n, *(fixed(m[s][k], 1) for k in ("median", "p95", "p99", "mean"))] for n, s in stages])]
        if m["weighted_accuracy"] is not None:
            out += ["### Weighted Metrics", "", f"- Weighted field accuracy: {percent(m['weighted_accuracy'])}", f"- Weighted document score (mean): {fixed(m['weighted_doc_score_mean'], 3)}", f"- Strict Doc-EM (for comparison): {percent(m['doc_em'])}", ""]
    if len(metrics) > 1:
        rows = [[k, str(m["n_succeeded"]), percent(m["micro_accuracy"]), percent(m["macro_accuracy"]), fixed(m["micro_f1"], 3), percent(m["doc_em"])] for k, m in metrics.items()]
        out += ["## Comparison Summary", "", *table(["System", "Docs", "Micro Acc", "Macro Acc", "Micro F1", "Doc-EM"], rows)]
    return "\n".join(out) + "\n"


def write(folder: str, metrics: dict[str, dict], markdown: str) -> None:
    """SNK8."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "report.md"), "w", encoding="utf-8") as f:
        f.write(markdown)
    with open(os.path.join(folder, "metrics.json"), "w", encoding="utf-8") as f:
        json.dump(metrics, f, ensure_ascii=False, indent=2, default=str)
