"""Fields from recognised text by patterns (X1-X7), and what goes into a model's prompt."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.normalize import checked_date, loose_amount, lookup

# The patterns, in Java's syntax; their flags are Unicode and, but for dates, any case. An amount is looked for
# from the first digit of a run on, where it would be found in any case: without the look-behind a long run is tried at each digit.
DATE = r"(?U)«?\s*(\d{1,2})\s*»?\s*[./]\s*(\d{1,2})\s*[./]\s*(\d{4})"
AMOUNT = r"(?iU)(?<!\d)(\d[\d\s]*[\d](?:[.,]\d{1,2})?)\s*(?:руб|рублей|₽|RUB|руб\.|рубль)"
AMOUNT_AFTER_WORD = r"(?iU)(?:сумм[аыеой]|размер[еа]?|составляет)\s*[:.]?\s*(\d[\d\s]*[\d](?:[.,]\d{1,2})?)"
IKZ = r"(?iU)(?:ИКЗ|икз|I[KК]З)\s*[:.]?\s*(\d{20,40})"
CURRENCY = r"(?iU)(руб|рублей|рубль|руб\.|₽|RUB|USD|EUR|доллар|евро)"
FOUND_CURRENCIES = {"руб": "RUB", "руб.": "RUB", "рублей": "RUB", "рубль": "RUB", "₽": "RUB", "rub": "RUB", "usd": "USD", "доллар": "USD", "eur": "EUR", "евро": "EUR"}
EACH_INN = r"(?sU)\G(.*?)\b(\d{10}|\d{12})\b"  # tried from the end of the match before only
BENEFICIARY = r"бенефициар|заявител|получател|государственн.*заказчик"
PRINCIPAL = r"принципал|заказчик|поставщик|подрядчик|исполнител"
CUT_MARK = "\n\n...[TRUNCATED FOR CONTEXT BUDGET]...\n\n"


def dates(text: Column) -> Column:
    """Valid dates in text order, as ISO texts."""
    parts = [F.regexp_extract_all(text, F.lit(DATE), F.lit(i)) for i in (1, 2, 3)]
    iso = F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "dmy", strict=True))), lambda x: checked_date(x["d"], x["m"], x["y"]))
    return F.filter(iso, lambda x: x.isNotNull())


def nth_date(text: Column, n: int) -> Column:
    """The n-th date, from 0; null beyond the last."""
    return F.get(dates(text), F.lit(n))


def first_match(text: Column, pattern: str) -> Column:
    """First group of the first match; none is null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def amount(text: Column) -> Column:
    """The number before a ruble sign, else, or if that is none, after a word for a sum."""
    return F.coalesce(loose_amount(first_match(text, AMOUNT)), loose_amount(first_match(text, AMOUNT_AFTER_WORD)))


def currency(text: Column) -> Column:
    """X5."""
    hit = first_match(text, CURRENCY)
    return F.coalesce(lookup(FOUND_CURRENCIES, F.regexp_replace(F.lower(hit), r"\.+$", "")), F.upper(hit))


def ikz(text: Column) -> Column:
    """X6."""
    return first_match(text, IKZ)


def mentions(text: Column) -> Column:
    """Each INN with the lower-cased 80 characters before it and 20 after, in text order.

    Each match takes the text since the one before along, so that running lengths give places.
    """
    parts = [F.regexp_extract_all(text, F.lit(EACH_INN), F.lit(i)) for i in (1, 2)]
    zipped = F.arrays_zip(parts[0].alias("gap"), parts[1].alias("inn"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<inn:string,start:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["inn"])).alias("at"), F.array_append(s["found"], F.struct(x["inn"].alias("inn"), begin.alias("start"))).alias("found"))

    def around(x: Column) -> Column:
        first = F.greatest(x["start"] - 80, F.lit(0))
        return F.lower(F.substring(text, first + 1, x["start"] + F.length(x["inn"]) + 20 - first))

    return F.transform(F.aggregate(zipped, start, step, lambda s: s["found"]), lambda x: F.struct(x["inn"].alias("inn"), around(x).alias("around")))


def inn_roles(text: Column, found: Column | None = None) -> Column:
    """Who is who. An INN takes the first role that its surroundings name and nobody has; the rest fill gaps. Null text has none.
    ``found`` are the text's ``mentions``, if a column has them: here they are used twice, and each use would look for them again."""
    found = mentions(text) if found is None else found
    nobody = F.struct(*(F.lit(None).cast("string").alias(r) for r in ("bank", "beneficiary", "principal")))

    def step(s: Column, x: Column) -> Column:
        around = x["around"]
        mark = F.instr(around, "инн")
        head = F.left(around, mark - 1)
        bank = s["bank"].isNull() & (mark > 0) & (around.contains("банк") | F.right(head, F.lit(40)).contains("гарант"))
        beneficiary = ~bank & s["beneficiary"].isNull() & around.rlike(BENEFICIARY)
        principal = ~bank & ~beneficiary & s["principal"].isNull() & around.rlike(PRINCIPAL)
        return F.struct(*(F.when(c, x["inn"]).otherwise(s[r]).alias(r) for r, c in (("bank", bank), ("beneficiary", beneficiary), ("principal", principal))))

    def filled(s: Column) -> Column:
        taken = F.array(s["bank"], s["beneficiary"], s["principal"])
        spare = F.filter(F.transform(found, lambda x: x["inn"]), lambda i: ~F.coalesce(F.array_contains(taken, i), F.lit(False)))
        principal = F.coalesce(s["principal"], F.get(spare, F.lit(0)))
        beneficiary = F.coalesce(s["beneficiary"], F.get(spare, F.when(s["principal"].isNull(), 1).otherwise(0)))
        return F.struct(principal.alias("principal_inn"), beneficiary.alias("beneficiary_inn"), s["bank"].alias("bank_inn"))

    return F.aggregate(F.coalesce(found, F.array().cast("array<struct<inn:string,around:string>>")), nobody, step, filled)


def with_roles(rows: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``inn_roles``; mentions and roles are columns of their own, so that each is computed once a row, however many fields are read."""
    held = rows.withColumn("_mentions", mentions(F.col(text)))
    return held.withColumn(into, inn_roles(F.col(text), F.col("_mentions"))).drop("_mentions")


def extract(text: Column, found: Column | None = None, who: Column | None = None) -> Column:
    """All fields as one struct; those that patterns don't find are null. ``found`` are the text's ``dates`` and ``who`` its ``inn_roles``, if columns have them."""
    who = inn_roles(text) if who is None else who
    found = dates(text) if found is None else found
    none = lambda kind="string": F.lit(None).cast(kind)
    return F.struct(
        none().alias("guarantee_number"), F.get(found, F.lit(0)).alias("issue_date"), F.get(found, F.lit(1)).alias("start_date"), F.get(found, F.lit(2)).alias("end_date"),
        amount(text).alias("amount"), currency(text).alias("currency"), who["principal_inn"].alias("principal_inn"), who["beneficiary_inn"].alias("beneficiary_inn"),
        none().alias("contract_number"), none().alias("contract_date"), none().alias("contract_name"), ikz(text).alias("ikz"), none().alias("bank_name"),
        who["bank_inn"].alias("bank_inn"), none("int").alias("claim_period_days"), F.lit("v1").alias("schema_version"), none("double").alias("extraction_confidence"),
        F.create_map().cast("map<string,string>").alias("evidence"), F.array().cast("array<string>").alias("warnings"),
    )


def budget_chars(context: int = 6144, max_tokens: int = 2048) -> int:
    """Characters of input that leave room for the answer: three to a token, at least 1200."""
    return max(1200, 3 * max(512, context - max(256, max_tokens + 512)))


def within_budget(text: Column, limit: int | None = None) -> Column:
    """X11: long text loses its middle; four fifths of what stays are the head."""
    limit = limit or budget_chars()
    head = int(limit * 0.8)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit(CUT_MARK), F.right(text, F.lit(limit - head)))).otherwise(text)


#: Keys of a record by schema version, in the order of the template.
RECORD_KEYS = {
    "v2": ["guarantee_number", "issue_date", "start_date", "end_date", "amount", "currency", "principal_inn", "beneficiary_inn", "ikz", "bank_name", "bank_inn", "schema_version"],
    "v1": ["guarantee_number", "issue_date", "start_date", "end_date", "amount", "currency", "principal_inn", "beneficiary_inn", "contract_number", "contract_date", "contract_name", "ikz", "bank_name", "bank_bic", "registry_number", "claim_period_days", "signatures_present", "schema_version", "extraction_confidence", "evidence", "warnings"],
}


def template(version: str) -> str:
    special = {"schema_version": version, "evidence": {}, "warnings": []}
    return json.dumps({k: special.get(k) for k in RECORD_KEYS[version]}, indent=2)


#: The system's instruction, and the wording of a question and of one asked again.
SYSTEM_PROMPT = (
    "Extract fields from OCR text of Russian bank guarantees.\nReturn exactly ONE valid JSON object, no markdown, no prose, no extra keys.\n"
    "Use YYYY-MM-DD dates, decimal dot for amount, and null when unknown.\nDo not invent values.\nINN must be digits only (10 or 12 digits).\n"
    "IKZ must be digits only (36 digits).\nIf start_date is not specified separately, it is equal to issue_date.\nCurrency should be a 3-letter code: RUB, USD, EUR, etc."
)
ASK = "Extract fields from OCR text.\nOutput ONE valid JSON object only.\n\n"
ASK_AGAIN = "Previous response is invalid.\nFix all errors and return ONE valid JSON object only.\n\nValidation errors:\n"


def schema_part(version: str) -> str:
    return f"Schema template ({version}):\n```json\n{template(version)}\n```\n\nOCR text:\n---\n"


def prompt(text: Column, version: str = "v2", errors: Column | None = None) -> Column:
    """What a model is asked, or asked again after ``errors`` (an array of texts); ``SYSTEM_PROMPT`` goes before it."""
    if errors is None:
        head = F.lit(ASK)
    else:
        bullets = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
        head = F.concat(F.lit(ASK_AGAIN), bullets, F.lit("\n\n"))
    return F.concat(head, F.lit(schema_part(version)), text, F.lit("\n---"))


def question(text: str, version: str = "v2", errors: list[str] | None = None) -> str:
    """X12 where the model is: the text of ``prompt``, so that no prompt is sent or stored."""
    head = ASK if errors is None else ASK_AGAIN + "\n".join(f"- {e}" for e in errors) + "\n\n"
    return f"{head}{schema_part(version)}{text}\n---"
