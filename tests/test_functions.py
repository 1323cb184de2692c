"""Scalar functions against values that follow from their rules."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.functions import metrics as M
from attestra.functions import normalize as N
from attestra.functions import structured as S
from attestra.functions import text as X


def apply(spark, f, values, kind="string"):
    """Results of a function of one column, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def apply2(spark, f, pairs, kind="string"):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"i int, p {kind}, g {kind}")
    return [r.x for r in rows.select("i", f(F.col("p"), F.col("g")).alias("x")).orderBy("i").collect()]


def test_text_or_null(spark):
    assert apply(spark, N.text_or_null, [" a  b ", "", "  \n", None]) == ["a  b", None, None, None]


def test_dates(spark):
    given = {
        "1.2.2023": "2023-02-01", "31.12.69": "1969-12-31", "31.12.68": "2068-12-31", "30.02.2023": "30.02.2023", "12/31/2023": "12/31/2023", "2023-12-31T10:00:00": "2023-12-31",
        "2023-1-5": "2023-01-05", "nan": None, "NaT": None, "": None, "  03.04.2021 ": "2021-04-03", "5/6/2020": "2020-06-05", "soon, maybe later": "soon, mayb",
    }
    assert apply(spark, N.iso_date, [*given, None]) == [*given.values(), None]


def test_amounts(spark):
    given = {"1 000,50": 1000.5, "1,234.56": 1234.56, "1.234,56": 1.23, "1,234,567": None, "1 000.50 руб.": None, "": None, "abc": None, "-5": -5.0, "1 200 руб": 1200.0, "5d": 5.0}
    assert apply(spark, N.amount, [*given, None]) == [*given.values(), None]
    assert apply(spark, N.number, [1.005, float("nan"), None, 2.0], "double") == [pytest.approx(1.0, abs=0.011), None, None, 2.0]


def test_identifiers_and_currencies(spark):
    assert apply(spark, N.digits, ["ИНН 77 07-083893", "abc", "007", "", None]) == ["7707083893", None, "007", None, None]
    assert apply(spark, N.currency, ["руб.", "₽", "RUR", "евро", "chf", "  ", None, "Российских рублей..", "$"]) == ["RUB", "RUB", "RUB", "EUR", "CHF", None, None, "RUB", "USD"]
    assert apply(spark, N.extracted_currency, ["руб.", "рур", "chf", "", None]) == ["RUB", "РУР", "CHF", "", None]
    assert apply(spark, N.one_spaced, [" a   b\n", ""]) == ["a b", ""]
    assert apply(spark, lambda c: N.field("ikz", c), ["1-2"]) == ["12"]
    assert apply(spark, lambda c: N.field("other", c), [" x "]) == ["x"]


def test_small_helpers(spark):
    assert apply(spark, N.loose_amount, ["1 000,50", "x", None]) == [1000.5, None, None]
    assert apply(spark, N.finite, [1.0, float("nan"), float("inf"), None], "double") == [1.0, None, None, None]
    assert apply(spark, N.percent, [0.5, None], "double") == ["50.0%", "—"]
    assert apply(spark, lambda c: N.decimals(c, 3), [0.5, None], "double") == ["0.500", "—"]
    assert apply(spark, N.duration, [999.0, 1000.0, 12345.0], "double") == ["999ms", "1.0s", "12.3s"]
    assert apply(spark, N.recogniser, [" ENG ", "xx"]) == ["en_PP-OCRv5_mobile_rec", N.DEFAULT_RECOGNISER]
    assert apply(spark, lambda c: N.content_name(c, F.lit("f.pdf")), ["abc"]) == ["ba7816bf8f01cfea_f.pdf"]
    rows = spark.createDataFrame([("31", "02", "2024"), ("0", "1", "2024"), ("1", "13", "2024"), ("1", "1", "1899")], "d string, m string, y string")
    assert [r[0] for r in rows.select(N.checked_date(F.col("d"), F.col("m"), F.col("y"))).collect()] == ["2024-02-31", None, None, None]


def test_metrics(spark):
    assert apply2(spark, M.exact_match, [(None, None), ("a", None), (None, "a"), ("a", "a"), ("a", "b")]) == [True, False, False, True, False]
    assert apply2(spark, M.edit_similarity, [(None, None), ("", None), ("", ""), ("kitten", "sitting"), ("привет", "превед")]) == [1.0, 0.0, 1.0, pytest.approx(4 / 7), pytest.approx(4 / 6)]
    assert apply2(spark, M.digit_accuracy, [(None, None), ("12", None), ("1234", "1239"), ("123", "1234"), ("a", "b"), ("1a2", "12")]) == [1.0, 0.0, 0.75, 0.75, 1.0, 1.0]
    assert apply2(spark, M.error_type, [(None, None), ("x", None), (None, "x"), ("x", "y"), ("x", "x")]) == ["correct", "extra", "missing", "wrong", "correct"]
    pairs = [(None, None), (1.0, None), (1.0, 1.005), (1.0, 1.5), (2.0, 0.0)]
    assert apply2(spark, M.within_tolerance, pairs, "double") == [True, False, True, False, False]
    assert apply2(spark, M.absolute_error, pairs, "double") == [None, None, pytest.approx(0.005), 0.5, 2.0]
    assert apply2(spark, M.relative_error, pairs, "double") == [None, None, pytest.approx(0.005 / 1.005), pytest.approx(1 / 3), None]


digit_texts = st.one_of(st.none(), st.text("0123456789a ", max_size=8))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(digit_texts, digit_texts), min_size=20, max_size=20))
def test_digit_accuracy_by_hand(spark, pairs):
    def by_hand(p, g):
        a, b = ("".join(c for c in x or "" if c.isdigit()) for x in (p, g))
        if not a and not b:
            return 1.0
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a and b else 0.0

    assert apply2(spark, M.digit_accuracy, pairs) == [pytest.approx(by_hand(p, g)) for p, g in pairs]


def test_pattern_extraction(spark):
    text = "от «15» .01.2024 до 31/12/2024, 99.99.2024"
    assert apply(spark, X.dates, [text, "115.01.2024", "", None]) == [["2024-01-15", "2024-12-31"], ["2024-01-15"], [], None]
    assert apply(spark, lambda c: X.nth_date(c, 1), [text, ""]) == ["2024-12-31", None]
    assert apply(spark, X.amount, ["5 руб", "1 000,50 руб", "Сумма: 2 500", "12 345.6 РУБЛЕЙ", "none"]) == [None, 1000.5, 2500.0, 12345.6, None]
    assert apply(spark, X.currency, ["100 Рублей", "in usd now", "no", "ЕВРО"]) == ["RUB", "USD", None, "EUR"]
    assert apply(spark, X.ikz, ["икз: " + "1" * 45, "ИКЗ " + "2" * 19, "iкз." + "3" * 20]) == ["1" * 40, None, "3" * 20]


def test_roles(spark):
    text = "Банк-гарант ИНН 7707083893. Принципал: ИНН 1234567890" + " " * 100 + "Бенефициар ИНН 123456789012"
    given = [text, "1111111111 and" + " " * 90 + "2222222222", ""]
    found = [tuple(r) for r in apply(spark, X.inn_roles, given)]
    assert found == [("1234567890", "123456789012", "7707083893"), ("1111111111", "2222222222", None), (None, None, None)]


def test_extract_record(spark):
    text = "Принципал ООО, ИНН 1234567890" + " . " * 40 + "Бенефициар ИНН 0987654321. 01.02.2024 по 03.04.2024. Сумма 1 500,00 руб. ИКЗ: " + "7" * 36
    r = apply(spark, X.extract, [text, None])
    assert (r[0].principal_inn, r[0].beneficiary_inn, r[0].issue_date, r[0].start_date, r[0].end_date) == ("1234567890", "0987654321", "2024-02-01", "2024-04-03", None)
    assert (r[0].amount, r[0].currency, r[0].ikz, r[0].schema_version, r[0].warnings, r[0].evidence) == (1500.0, "RUB", "7" * 36, "v1", [], {})
    assert r[1].principal_inn is None and len(r[0]) == 19


def test_context_budget(spark):
    assert X.budget_chars() == 10752 and X.budget_chars(1000, 2048) == 1536
    short, long = "x" * 10752, "h" * 8601 + "m" + "t" * 2151
    assert apply(spark, X.within_budget, [short, long]) == [short, "h" * 8601 + X.CUT_MARK + "t" * 2151]


def test_prompts(spark):
    first = apply(spark, X.prompt, ["text"])[0]
    assert first.startswith("Extract fields from OCR text.\n") and '"schema_version": "v2"' in first and first.endswith("---\ntext\n---")
    again = apply(spark, lambda c: X.prompt(c, "v1", F.array(F.lit("a"), F.lit("b"))), ["text"])[0]
    assert "- a\n- b\n" in again and '"evidence": {}' in again


def test_json_block(spark):
    given = ['x {"a": {"b": 1}} y {"c": 2}', "} no {open", None]
    assert apply(spark, S.first_object, given) == ['{"a": {"b": 1}}', "} no {open", None]


def check(spark, answers, version="v2"):
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    return S.with_validated(rows, "a", version).orderBy("i").collect()


def test_validation_v2(spark):
    got = check(
        spark,
        [
            '```json\n{"guarantee_number": " G  1 ", "principal_inn": "77-07083893", "currency": "руб", "amount": 10.5, "surplus": 1,}\n```',
            "no braces here", '{"guarantee_number": "X", amount: open', '{"principal_inn": "123"}', '{"amount": -100}', '{"ikz": "none"}',
            '{"start_date": "2024-02-01", "end_date": "2024-01-01"}', "[1, 2]", '{"principal_inn": 1234567890}', '{"issue_date": "2024-13-01"}', '{"amount": 5, "nested": {"a": 1}', None,
        ],
    )
    ok = got[0]
    assert ok.errors == [] and (ok.record.guarantee_number, ok.record.principal_inn, ok.record.currency, ok.record.amount, ok.record.schema_version) == ("G 1", "7707083893", "RUB", 10.5, "v2")
    assert got[1].errors == ["JSON parse error"] and got[2].errors == ["JSON parse error"] and got[11].errors == ["JSON parse error"]
    assert "10 or 12 digits, got 3" in got[3].errors[0] and "non-negative" in got[4].errors[0] and "must contain digits" in got[5].errors[0]
    assert "start_date (2024-02-01) is after end_date (2024-01-01)" in got[6].errors[0]
    assert got[7].errors == ["JSON root must be an object"]
    assert any("not a valid string" in e for e in got[8].errors) and any("issue_date" in e for e in got[9].errors)
    assert got[10].errors == [] and got[10].record.amount == 5.0
    assert all((r.record is None) == bool(r.errors) for r in got)


def test_validation_v1(spark):
    got = check(spark, ['{"schema_version": "v1"}', '{"issue_date": "2024-02-01", "end_date": "2024-01-01", "warnings": ["w"], "evidence": {"a": "b"}}', '{"extraction_confidence": 1.5}'], "v1")
    assert got[0].errors == [] and got[0].record.issue_date is None
    assert got[1].errors == [] and got[1].record.issue_date == datetime.date(2024, 2, 1) and got[1].record.evidence == {"a": "b"}
    assert got[1].record.warnings == ["w", "issue_date (2024-02-01) is after end_date (2024-01-01)"]
    assert "between 0 and 1" in got[2].errors[0]


def test_unknown_keys(spark):
    rows = spark.createDataFrame([('{"amount": 1, "odd": 2}',)], "a string")
    assert rows.select(S.unknown_keys(F.try_parse_json("a"), "v2").alias("k")).first().k == ["odd"]
    assert apply(spark, S.schema_version, ["v1", "v3", None]) == ["v1", "v2", "v2"]


def test_printed_decimals_round_the_binary_value_halves_to_even(spark):
    values = [k * 500 / 10000 for k in range(200)] + [-0.15, 0.25, 0.35, 0.0005, 1.0005, 2.5, 1e-9, 1e16, 123456789012.35, 0.0]
    assert apply(spark, lambda c: N.decimals(c, 1), values, "double") == [f"{v:.1f}" for v in values]
    assert apply(spark, lambda c: N.decimals(c, 3), values, "double") == [f"{v:.3f}" for v in values]
    assert apply(spark, N.percent, values, "double") == [f"{v * 100:.1f}%" for v in values]
    totals = [500.0 * k for k in range(1, 1000)]
    assert apply(spark, lambda c: N.percent(c, F.lit(1000000)), totals, "double") == [f"{v / 10000:.1f}%" for v in totals]
    times = [0.5, 1.5, 2.5, 1050.0, 1250.0, 1350.0, 2450.0]
    assert apply(spark, N.duration, times, "double") == [f"{v:.0f}ms" if v < 1000 else f"{v / 1000:.1f}s" for v in times]
