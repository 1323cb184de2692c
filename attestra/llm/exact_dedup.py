"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: after the first sentence end or line end
that follows ``min_chunk`` characters, at ``max_chunk`` characters at the latest. Equal
texts are thus cut alike. A chunk's identifier is its SHA-256; one aggregation over the
chunk texts, combined on the map side, verifies that no identifier names two different
texts. From there on only the ordered identifier lists ("recipes") move: documents are
equal when their recipes are, and long texts are not moved a second time.

Should an identifier ever name two texts (``weak_digest`` makes it so in tests), the
lists hold the chunks themselves: slower, still exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import ascii_lower, join_uses, table, written


def chunk_pattern(min_chunk: int, max_chunk: int) -> str:
    return rf"(?s).{{{min_chunk},{max_chunk - 1}}}?[.\n]|.{{1,{max_chunk}}}"


def chunks_of(text: Column, min_chunk: int, max_chunk: int) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0))


def identifier(chunk: Column, weak_digest: bool) -> Column:
    return F.unhex(F.substring(F.sha2(chunk, 256), 1, 1) if weak_digest else F.sha2(chunk, 256))


def ambiguous_identifiers(texts: DataFrame, min_chunk: int, max_chunk: int, weak_digest: bool) -> DataFrame:
    """Identifiers that name more than one chunk text. Hot chunks are combined before the shuffle."""
    chunks = texts.select(F.explode(chunks_of(F.col("_text"), min_chunk, max_chunk)).alias("chunk"))
    named = chunks.select(identifier(F.col("chunk"), weak_digest).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return named.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chunk: int = 1024, max_chunk: int = 8192, weak_digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with
    the largest id stays. Null text counts as empty, and all empty texts are one group.
    Rows that repeat an id are all counted, and all rows of the id kept stay. Rows with a
    null id group by text like any other; a group of null ids only keeps those. An empty
    table gives an empty result. Other columns of the input, whatever their names, are
    not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    exact = bool(ambiguous_identifiers(texts, min_chunk, max_chunk, weak_digest).take(1))
    chunks = chunks_of(F.col("_text"), min_chunk, max_chunk)
    recipe = F.transform(chunks, lambda c: F.encode(c, "UTF-8")) if exact else F.transform(chunks, lambda c: identifier(c, weak_digest))
    recipes = written(texts.select("_id", recipe.alias("_recipe"), F.sha2(F.col("_text"), 256).alias("text_sha256")), "recipes")
    groups = written(recipes.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return join_uses(recipes, groups, ["_recipe"], "group_size").select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
