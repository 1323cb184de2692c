"""Elementary comparison of a predicted with a true value (M1-M8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.normalize import AMOUNT_FIELDS, DATE_FIELDS, ID_FIELDS

ERROR_TYPES = ("correct", "missing", "wrong", "extra")


def _with_nulls(p: Column, g: Column, both: object, one: object, value: Column) -> Column:
    return F.when(p.isNull() & g.isNull(), both).when(p.isNull() | g.isNull(), one).otherwise(value)


def exact_match(p: Column, g: Column) -> Column:
    """M1: equal, two nulls too."""
    return p.eqNullSafe(g)


def edit_similarity(p: Column, g: Column) -> Column:
    """M2: 1 less the edit distance as a part of the longer text; two empty or null texts are alike."""
    longest = F.greatest(F.length(p), F.length(g))
    return _with_nulls(p, g, 1.0, 0.0, F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(p, g) / longest))


def digit_accuracy(p: Column, g: Column) -> Column:
    """M3: share of positions with equal digits, of the longer row of digits."""
    a, b = (F.coalesce(F.regexp_replace(x, r"(?U)\D", ""), F.lit("")) for x in (p, g))
    longest = F.greatest(F.length(a), F.length(b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.when(longest == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / longest)


def absolute_error(p: Column, g: Column) -> Column:
    """M4."""
    return F.abs(p - g)


def relative_error(p: Column, g: Column) -> Column:
    """M5: null where the true value is null or 0."""
    return F.try_divide(F.abs(p - g), F.abs(g))


def within_tolerance(p: Column, g: Column, tolerance: float = 0.01) -> Column:
    """M6."""
    return _with_nulls(p, g, True, False, F.abs(p - g) <= tolerance)


def error_type(p: Column, g: Column) -> Column:
    """M7."""
    return F.when(exact_match(p, g), "correct").when(g.isNull(), "extra").when(p.isNull(), "missing").otherwise("wrong")


def diagnostics(name: str, p: Column, g: Column, tolerance: float = 0.01) -> dict[str, Column]:
    """M8: what is measured of a field; measures of other kinds of fields are null."""
    text = name in ID_FIELDS or name in DATE_FIELDS
    money = name in AMOUNT_FIELDS
    none = F.lit(None).cast("double")
    return {
        "is_match": exact_match(p, g),
        "error_type": error_type(p, g),
        "edit_similarity": edit_similarity(p, g) if text else none,
        "digit_acc": digit_accuracy(p, g) if name in ID_FIELDS else none,
        "abs_error": absolute_error(p, g) if money else none,
        "rel_error": relative_error(p, g) if money else none,
        "within_tolerance": within_tolerance(p, g, tolerance) if money else F.lit(None).cast("boolean"),
    }
