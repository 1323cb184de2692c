"""Evaluation of predicted against true fields: diagnostics, aggregates and their layouts.

Diagnostics are computed before any unpivot, in the scan's own stage; metrics of all eight
fields then come from one aggregation over the wide rows, so one shuffle of a few partial
rows a group, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import metrics as M
from attestra.functions.normalize import AMOUNT_FIELDS, DATE_FIELDS, FIELDS, ID_FIELDS, field, finite
from attestra.operators.ranks import quantiles

GROUP = ("ocr_engine", "extractor")
STAGES = ("ocr_ms", "extract_ms", "total_ms")
MEASURES = {"edit_similarity": "edit_sim", "digit_acc": "digit_acc", "abs_error": "abs_error", "within_tolerance": "within_tol"}


def normalised(rows: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """``g_<field>`` and ``p_<field>`` from columns ``gold_<field>`` and ``pred_<field>``."""
    return rows.withColumns({f"{side}_{f}": field(f, F.col(f"{name}_{f}")) for f in fields for side, name in (("g", "gold"), ("p", "pred"))})


def with_diagnostics(rows: DataFrame, tolerance: float = 0.01, fields: dict[str, str] = FIELDS, only: tuple[str, ...] | None = None) -> DataFrame:
    """M9: one struct ``d_<field>`` a field, from normalised values; with ``only`` no other measures than these, since what
    is exploded later is computed whole."""
    return rows.withColumns({f"d_{f}": F.struct(*(c.alias(k) for k, c in M.diagnostics(f, F.col(f"p_{f}"), F.col(f"g_{f}"), tolerance).items() if only is None or k in only), F.col(f"g_{f}").isNotNull().alias("has_gold")) for f in fields})


def tall(rows: DataFrame, *keys: str, fields: dict[str, str] = FIELDS) -> DataFrame:
    """P10 of structs: one row a document and field."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").cast("string").alias("pred_value"), F.col(f"g_{f}").cast("string").alias("gold_value"), F.col(f"d_{f}").alias("d")) for f in fields)))
    return rows.select(*keys, each.alias("x")).select(*keys, "x.field", "x.pred_value", "x.gold_value", "x.d.*")


def wide(diagnosed: DataFrame, *keys: str, fields: dict[str, str] = FIELDS, only: tuple[str, ...] | None = None) -> DataFrame:
    """The result layout ``match_<f>, error_type_<f>`` and, where they apply, the measures; with ``only`` no other measures than these."""
    columns = []
    for f in fields:
        columns += [F.col(f"d_{f}.is_match").alias(f"match_{f}"), F.col(f"d_{f}.error_type").alias(f"error_type_{f}")]
        applies = {"edit_similarity": f in ID_FIELDS or f in DATE_FIELDS, "digit_acc": f in ID_FIELDS, "abs_error": f in AMOUNT_FIELDS, "within_tolerance": f in AMOUNT_FIELDS}
        columns += [F.col(f"d_{f}.{m}").alias(f"{short}_{f}") for m, short in MEASURES.items() if applies[m] and (only is None or m in only)]
    return diagnosed.select(*keys, *columns)


def from_wide(rows: DataFrame, *keys: str, tolerance: float = 0.01, fields: dict[str, str] = FIELDS, only: tuple[str, ...] | None = None) -> DataFrame:
    """P10: the result layout as one row a document and field. Columns that a run lacks count as no match,
    ``missing``; the amount's tolerance is computed from the stored values where it is absent. With ``only`` no other
    measures than these. What is exploded is a column of its own: a projection may share the parsed texts between
    fields, a generator does not. It is exploded as outer, though it never is empty: else the optimizer asks for its size
    in a filter, which it moves down to the scan with all that the column is made of.
    """
    have = set(rows.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    stored = {f"_{side}": F.from_json(f"{side}_json", "map<string,string>") if f"{side}_json" in have else F.lit(None).cast("map<string,string>") for side in ("gold", "pred")}
    parsed = rows.withColumns(stored)
    each = []
    for f in fields:
        g, p = F.try_element_at("_gold", F.lit(f)), F.try_element_at("_pred", F.lit(f))
        tol = col(f"within_tol_{f}", "boolean")
        if f in AMOUNT_FIELDS:
            gn, pn = field(f, g), field(f, p)
            tol = F.coalesce(tol, M.within_tolerance(pn, gn, tolerance))
        measures = {
            "is_match": F.coalesce(col(f"match_{f}", "boolean"), F.lit(False)), "error_type": F.coalesce(col(f"error_type_{f}", "string"), F.lit("missing")),
            "edit_similarity": finite(col(f"edit_sim_{f}", "double")), "digit_acc": finite(col(f"digit_acc_{f}", "double")),
            "abs_error": finite(col(f"abs_error_{f}", "double")), "within_tolerance": tol,
        }
        each.append(F.struct(F.lit(f).alias("field"), p.alias("pred_value"), g.alias("gold_value"), *(c.alias(k) for k, c in measures.items() if only is None or k in only), g.isNotNull().alias("has_gold")))
    return parsed.select(*keys, F.array(*each).alias("_each")).select(*keys, F.explode_outer("_each").alias("x")).select(*keys, "x.*")


def ratio(top: Column, bottom: Column) -> Column:
    """A5: 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """A5."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def field_sums(diagnosed: DataFrame, group: tuple[str, ...] = GROUP, wrong_counts_as_fn: bool = True, weights: dict[str, float] | None = None, fields: dict[str, str] = FIELDS) -> DataFrame:
    """One row a group with what every metric needs; nulls in the group's keys are dropped.

    Of each field a struct ``f_<field>`` of counts and means, besides ``n_docs``, ``doc_em``
    and the weighted sums.
    """
    sums = []
    for f in fields:
        d = lambda m, f=f: F.col(f"d_{f}.{m}")
        kind, gold = d("error_type"), d("has_gold")
        sums += [
            _count(d("is_match"), f"m_{f}"), _count(d("is_match") & gold, f"tp_{f}"),
            _count(kind.isin("extra", "wrong"), f"fp_{f}"), _count(kind.isin("missing", "wrong") if wrong_counts_as_fn else kind == "missing", f"fn_{f}"),
            *(_count(kind == e, f"{e}_{f}") for e in M.ERROR_TYPES), F.avg(d("edit_similarity")).alias(f"edit_{f}"), F.avg(d("digit_acc")).alias(f"digit_{f}"),
            F.sum(d("abs_error")).alias(f"ae_{f}"), F.count(d("abs_error")).alias(f"nae_{f}"), _count(d("within_tolerance"), f"tol_{f}"), F.count(d("within_tolerance")).alias(f"ntol_{f}"),
        ]
    whole = [F.col(f"d_{f}.is_match") for f in fields]
    every = whole[0]
    for c in whole[1:]:
        every = every & c
    known = {f: w for f, w in (weights or {}).items() if f in fields}
    score = sum((F.col(f"d_{f}.is_match").cast("double") * w for f, w in known.items()), F.lit(0.0)) / (sum(known.values()) or 1.0)
    n = F.count(F.lit(1))
    sums += [n.alias("n_docs"), F.avg(every.cast("double")).alias("doc_em")]
    sums += [F.avg(score).alias("weighted_doc_score") if sum(known.values()) else F.lit(None).cast("double").alias("weighted_doc_score")]
    present = diagnosed
    for k in group:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*group).agg(*sums)


def field_metrics(sums: DataFrame, group: tuple[str, ...] = GROUP, fields: dict[str, str] = FIELDS) -> DataFrame:
    """A1, A4, A5, A9, A10, A13 by group and field."""
    names = {"m": "matches", "tp": "tp", "fp": "fp", "fn": "fn", "edit": "avg_edit_sim", "digit": "avg_digit_acc", **{e: e for e in M.ERROR_TYPES}}
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f"{k}_{f}").alias(v) for k, v in names.items())) for f in fields)))
    rows = sums.select(*group, "n_docs", each.alias("x")).select(*group, "n_docs", "x.*")
    return rows.withColumns({"accuracy": ratio(F.col("matches"), F.col("n_docs")), **prf(F.col("tp"), F.col("fp"), F.col("fn"))})


def group_metrics(sums: DataFrame, group: tuple[str, ...] = GROUP, weights: dict[str, float] | None = None, fields: dict[str, str] = FIELDS) -> DataFrame:
    """A2, A3, A6-A8, A11-A13, A15, A16 by group."""
    total = lambda k: sum((F.col(f"{k}_{f}") for f in fields), F.lit(0))
    k = len(fields)
    micro = prf(total("tp"), total("fp"), total("fn"))
    f1 = sum((prf(F.col(f"tp_{f}"), F.col(f"fp_{f}"), F.col(f"fn_{f}"))["f1"] for f in fields), F.lit(0.0)) / k
    macro = sum((ratio(F.col(f"m_{f}"), F.col("n_docs")) for f in fields), F.lit(0.0)) / k
    known = {f: w for f, w in (weights or {}).items() if f in fields}
    weighed = sum((F.col(f"m_{f}") * F.lit(w) for f, w in known.items()), F.lit(0.0))
    money = [f for f in fields if f in AMOUNT_FIELDS]
    return sums.select(
        *group, "n_docs", "doc_em", ratio(total("m"), F.col("n_docs") * k).alias("micro_accuracy"), macro.alias("macro_accuracy"),
        *(c.alias(f"micro_{n}") for n, c in micro.items()), f1.alias("macro_f1"),
        F.try_divide(sum((F.coalesce(F.col(f"ae_{f}"), F.lit(0.0)) for f in money), F.lit(0.0)), sum((F.col(f"nae_{f}") for f in money), F.lit(0))).alias("amount_mae"),
        F.try_divide(sum((F.col(f"tol_{f}") for f in money), F.lit(0)), sum((F.col(f"ntol_{f}") for f in money), F.lit(0))).alias("amount_tolerance_acc"),
        *(total(e).alias(e) for e in M.ERROR_TYPES), F.try_divide(weighed, F.lit(float(sum(known.values()))) * F.col("n_docs")).alias("weighted_accuracy"), "weighted_doc_score",
    )


def status_counts(rows: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """All, succeeded and failed documents of each configuration."""
    ok = F.col("status").eqNullSafe("succeeded")
    present = rows
    for k in group:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), _count(ok, "succeeded"), _count(~ok, "failed"))


def succeeded(rows: DataFrame) -> DataFrame:
    """Failed documents count in no metric."""
    return rows.where("status = 'succeeded'")


def latency_stats(rows: DataFrame, group: tuple[str, ...] = GROUP, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Count, median, p95, p99 (linear interpolation, exact) and mean of each stage. Null counts as 0 ms."""
    found = quantiles(rows, group, {s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in stages}, (0.5, 0.95, 0.99))
    return found.select(*group, "stage", "n", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "p95", "p99"))), "mean")


def equal_fields(gold: DataFrame, pred: DataFrame, key: str, skip: tuple[str, ...] = ("schema_version", "extraction_confidence", "evidence", "warnings")) -> DataFrame:
    """M10, JN4, JN7, A23: plain equality of the shared columns of two tables, of documents that both have."""
    shared = [c for c in gold.columns if c in pred.columns and c != key and c not in skip]
    joined = gold.alias("g").join(pred.alias("p"), F.col(f"g.{key}") == F.col(f"p.{key}"), "left")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")).alias("equal")) for c in shared)))
    return joined.where(F.col(f"p.{key}").isNotNull()).select(F.col(f"g.{key}").alias(key), each.alias("x")).select(key, "x.*")
