"""Normalisation of field values (N0-N16). All are built-in expressions, so scans stay in generated code.

``(?U)`` makes Java's classes Unicode-aware: white space includes the no-break space, and
digits of all scripts are digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and signs of a currency, and its code.
CURRENCIES = {
    "руб": "RUB", "руб.": "RUB", "рублей": "RUB", "рубль": "RUB", "рубли": "RUB", "российских рублей": "RUB", "рур": "RUB", "rur": "RUB", "rub": "RUB", "₽": "RUB",
    "usd": "USD", "долларов": "USD", "$": "USD", "доллар": "USD", "eur": "EUR", "евро": "EUR", "€": "EUR",
}
#: The same for values that a model extracted.
EXTRACTED_CURRENCIES = {
    "руб": "RUB", "руб.": "RUB", "рублей": "RUB", "рубль": "RUB", "российских рублей": "RUB", "rub": "RUB", "₽": "RUB",
    "usd": "USD", "долларов": "USD", "$": "USD", "eur": "EUR", "евро": "EUR", "€": "EUR",
}
#: Recogniser model of each language setting.
RECOGNISERS = {
    "rus": "eslav_PP-OCRv5_mobile_rec", "rus+eng": "eslav_PP-OCRv5_mobile_rec", "eng": "en_PP-OCRv5_mobile_rec",
    "chi_sim": "PP-OCRv5_mobile_rec", "deu": "latin_PP-OCRv5_mobile_rec", "fra": "latin_PP-OCRv5_mobile_rec",
}
DEFAULT_RECOGNISER = "eslav_PP-OCRv5_mobile_rec"

#: Evaluated fields in their order, and what predictions call them; the fields of each rule.
FIELDS = {"pcpl_inn": "principal_inn", "bene_inn": "beneficiary_inn", "issue_date": "issue_date", "start_date": "start_date", "end_date": "end_date", "sum": "amount", "currency": "currency", "ikz": "ikz"}
ID_FIELDS = ("pcpl_inn", "bene_inn", "bank_inn", "principal_inn", "beneficiary_inn", "ikz")
DATE_FIELDS = ("issue_date", "start_date", "end_date")
AMOUNT_FIELDS = ("sum", "amount")


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def text_or_null(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def digits(c: Column) -> Column:
    """The digits alone, leading zeros kept; none is null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)\D", ""), F.lit(""))


def iso_date(c: Column) -> Column:
    """ISO date of the first ten characters by the known formats, else those characters.

    Each format is rewritten to year-month-day by one replacement of the whole, so that the text
    is named once and parsed once: the expression stays small enough for generated code.
    """
    head = F.left(text_or_null(c), F.lit(10))
    ymd = head
    for pattern, to in (
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
        (r"^(\d{1,2})\.(\d{1,2})\.(69|[7-9]\d)$", "19$3-$2-$1"),
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", "20$3-$2-$1"),
        (r"(?s)^(?!\d{4}-\d{1,2}-\d{1,2}$).*$", ""),
    ):
        ymd = F.regexp_replace(ymd, pattern, to)
    none = F.regexp_replace(head, r"(?i)^(nat|nan|none)$", "")
    return F.coalesce(F.try_to_date(ymd, "yyyy-M-d").cast("string"), F.nullif(none, F.lit("")))


def number(c: Column) -> Column:
    """N4 of a number: not-a-number is null, two decimals."""
    x = c.cast("double")
    return F.when(~F.isnan(x), F.bround(x, 2))


def amount(c: Column) -> Column:
    """N4 of a text: with both marks commas group, a comma alone is the decimal mark; no number is null."""
    k = F.regexp_replace(c.cast("string"), r"(?U)[^\d.,\-]", "")
    return F.bround(F.replace(k, F.lit(","), F.when(k.contains("."), "").otherwise(".")).try_cast("double"), 2)


def currency(c: Column) -> Column:
    """Code of a known word or sign, else upper case."""
    s = text_or_null(c)
    return F.coalesce(lookup(CURRENCIES, F.regexp_replace(F.lower(s), r"\.+$", "")), F.upper(s))


def field(name: str, c: Column) -> Column:
    """The rule of a field."""
    if name in ID_FIELDS:
        return digits(c)
    if name in DATE_FIELDS:
        return iso_date(c)
    if name in AMOUNT_FIELDS:
        return amount(c)
    return currency(c) if name == "currency" else text_or_null(c)


def one_spaced(c: Column) -> Column:
    """N9 of any text: white space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def extracted_currency(c: Column) -> Column:
    """N9 of a currency: another table than N5's, and dots stay; a blank one keeps its (empty) text."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s == "", one_spaced(c)).otherwise(one_spaced(F.coalesce(lookup(EXTRACTED_CURRENCIES, s), F.upper(s))))


def loose_amount(c: Column) -> Column:
    """White space dropped, comma as decimal mark."""
    return F.bround(F.replace(F.regexp_replace(c, r"(?U)\s", ""), F.lit(","), F.lit(".")).try_cast("double"), 2)


def checked_date(day: Column, month: Column, year: Column) -> Column:
    """Zero-padded ISO text if each part is in range; no calendar check."""
    d, m, y = (x.try_cast("int") for x in (day, month, year))
    return F.when(d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100), F.format_string("%04d-%02d-%02d", y, m, d))


def finite(c: Column) -> Column:
    """Not-a-number and infinities are null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _rounded(c: Column, places: int) -> Column:
    """The double nearest to ``c`` rounded to decimals by its binary value, halves to even, as C and Python print it.

    Java's formats round the shortest decimal that reads as ``c``, halves up: 0.15, which lies below its name, becomes
    0.2. Where the scaled value seems to be a half, the error of the product (by halves of 26 bits) tells its side.
    """
    scale, a = 10.0**places, F.abs(c)
    p, t = a * scale, a * 134217729.0
    high = t - (t - a)
    low, down = a - high, F.floor(p).cast("double")
    error = (high * scale - p) + low * scale
    up = F.when(p - down != 0.5, p - down > 0.5).when(error != 0, error > 0).otherwise(down % 2 == 1)
    near = (down + up.cast("double")) / scale
    return F.when(p < 4503599627370496.0, F.when(c < 0, -near).otherwise(near)).otherwise(c)


def percent(c: Column, of: Column | None = None) -> Column:
    """Share, or part ``of`` a whole, as percent with one decimal; null is a dash. The hundredfold part is divided once."""
    c = c.cast("double") * 100
    c = c if of is None else F.try_divide(c, of)
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.1f%%", _rounded(c, 1)))


def decimals(c: Column, places: int) -> Column:
    """Fixed decimals; null is a dash."""
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{places}f", _rounded(c.cast("double"), places)))


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    return F.when(ms < 1000, F.format_string("%.0fms", _rounded(ms.cast("double"), 0))).otherwise(F.format_string("%.1fs", _rounded(ms.cast("double") / 1000, 1)))


def content_hash(content: Column) -> Column:
    """N15."""
    return F.sha2(content, 256)


def content_name(content: Column, name: Column) -> Column:
    """File name led by the content's hash."""
    return F.concat(F.substring(content_hash(content), 1, 16), F.lit("_"), name)


def recogniser(lang: Column) -> Column:
    """X17."""
    return F.coalesce(lookup(RECOGNISERS, F.lower(F.trim(lang))), F.lit(DEFAULT_RECOGNISER))
