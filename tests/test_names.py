"""Unique names by rounds against the sequential rule."""

from __future__ import annotations

import random
import re

import pytest

from attestra.operators import names, records


def sequential(given):
    used, out = {}, []
    for name in given:
        if name is None:
            out.append(None)
        elif name not in used:
            used[name] = 1
            out.append(name)
        else:
            stem, ending = re.fullmatch(r"(?s)(.+?)(\.[^.]*)?", name).groups()
            k = used[name]
            while f"{stem}__{k}{ending or ''}" in used:
                k += 1
            used[name] += 1
            used[f"{stem}__{k}{ending or ''}"] = 1
            out.append(f"{stem}__{k}{ending or ''}")
    return out


def check(spark, given):
    rows = [(i, n, "x", 3) for i, n in enumerate(given)]
    table = spark.createDataFrame(rows, "id long, n string, child string, k int").repartition(3)
    got = {r.id: (r.n, r.unique_name, r.child) for r in names.unique_names(table, "n", "id").collect()}
    assert got == {i: (n, u, "x") for i, (n, u) in enumerate(zip(given, sequential(given), strict=True))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_as_by_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    pool = ["a.pdf"] * 6 + [None, "b", ".b", "a.tar.gz", "x.y__1", "__1.pdf", "a__01.pdf", "a__0.pdf", "a__1__1.pdf", "a__2__1.pdf", "a__1__1__1.pdf", "b__2", "a__99999999999999999999.pdf"] + [f"a__{k}.pdf" for k in range(1, 9)]
    check(spark, [r.choice(pool) for _ in range(80)])


def test_names_without_clashes(spark):
    check(spark, ["a.pdf", "b.pdf", "a.pdf", None, "a.pdf", "b", "", None, "b"][:6] + ["b"])
    assert names.unique_names(spark.createDataFrame([], "id long, n string"), "n", "id").collect() == []


def test_a_hot_name(spark):
    """A third of all rows under one name, with numbers given before and after their turn."""
    given = [("hot.pdf" if i % 3 else f"f{i}.pdf") for i in range(1500)]
    for at, k in ((0, 3), (10, 4), (500, 2), (700, 100), (900, 990), (1499, 1001)):
        given[at] = f"hot__{k}.pdf"
    check(spark, given)


def test_missing_fields_of_documents_without_any_row(spark):
    docs = spark.createDataFrame([(1, "e"), (2, "e"), (None, "e"), (3, None), (1, "e")], "id long, engine string")
    diags = spark.createDataFrame([(1, "e", "sum", True, "correct"), (None, "e", "inn", False, "wrong"), (9, "e", "sum", True, "correct")], "id long, engine string, field string, is_match boolean, error_type string")
    got = sorted((r.id or 0, r.engine or "", r.field, r.is_match, r.error_type) for r in records.with_missing_fields(diags, ["id", "engine"], ["sum", "inn"], docs).collect())
    missing = lambda i, e, f: (i, e, f, False, "missing")
    assert got == sorted([(1, "e", "sum", True, "correct"), missing(1, "e", "inn"), missing(2, "e", "sum"), missing(2, "e", "inn"), missing(0, "e", "sum"), (0, "e", "inn", False, "wrong"), missing(3, "", "sum"), missing(3, "", "inn")])


def test_questions_are_the_prompts_and_are_not_stored(spark, monkeypatch):
    from pyspark.sql import functions as F

    from attestra.functions import text as X
    from attestra.operators import extraction

    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id long, text string")
    wanted = docs.where("text IS NOT NULL").select("text", X.prompt(F.col("text")).alias("q"), X.prompt(F.col("text"), "v1", F.array(F.lit("a"), F.lit("b"))).alias("again")).collect()
    for r in wanted:
        assert X.question(r.text) == r.q
        assert X.question(r.text, "v1", ["a", "b"]) == r.again
    stored, write = [], extraction.materialised
    monkeypatch.setattr(extraction, "materialised", lambda df: (stored.append(df.columns), write(df))[1])

    def make():
        def generate(system, q, schema):
            raise AssertionError("called one by one")

        def many(system, questions, schema):
            return ['{"principal_inn": "7707083893"}' if "two" in q or q.startswith("Previous") else "no" for q in questions]

        generate.many = many
        return generate

    for key in ("id", None):
        got = {r.id: (r.status, r.attempts) for r in extraction.extract_by_model(docs, make, key=key).collect()}
        assert got == {1: ("succeeded", 2), 2: ("succeeded", 1), 3: ("succeeded", 2)}
    assert stored.count(["_row", "status", "record", "raw", "errors", "warnings", "attempts"]) == 6
    assert [c for c in stored if "text" in c] == [["id", "text", "_row"]]
