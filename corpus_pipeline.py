"""A training corpus from ``documents``: five operators in a row, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.bpe import default_path, encode_documents
from attestra.llm.common import ascii_lower, table, written
from attestra.llm.exact_dedup import exact_dedup
from attestra.llm.jaccard_join import jaccard_components
from attestra.llm.language_id import fold, identify, learn_profiles
from attestra.llm.mixing import mix_sources

BROADCAST_ROWS = 400_000


def _packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc_id``, ``text`` and every column as ``c0, c1, ...``, so that no name of an input meets one of ours; and those names."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))), [f"c{i}" for i in range(len(docs.columns))]


def _unpacked(rows: DataFrame, docs: DataFrame, mark: str = "") -> DataFrame:
    return rows.select(*(F.col(f"{mark}c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less those of ``gone`` by ``_id`` (null too) and ``_sha``; broadcast only if they are few enough, else shuffled."""
    gone = written(gone.select(F.col("_id").alias("_gone_id"), F.col("_sha").alias("_gone_sha")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go, and no others, whatever was learned.

    Null and empty texts have no letter. Null and repeated ids, and other columns, of any
    names, pass through; null ids teach no language. An empty table gives an empty one.
    """
    rows, names = _packed(docs)
    profiles = learn_profiles(docs.where(fold() != 0))
    return _unpacked(identify(rows, profiles, keep=tuple(names)).where("NOT rejected"), docs, "k_")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, of several rows of that id, or of none, the first by their values as JSON.

    Null texts count as empty and are one group. Null ids stay only where no equal text has an
    id. Other columns, of any names and kinds, pass through. An empty table gives an empty one.
    """
    rows, names = _packed(docs)
    rows = rows.withColumn("_sha", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    found = written(exact_dedup(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "exact")
    left = _gone(rows, found.where("NOT kept"))
    again = written(found.where("kept").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    if not again.take(1):
        return _unpacked(left, docs)
    repeated = left.join(again.select(F.col("_id").alias("_again_id"), F.col("_sha").alias("_again_sha")), F.col("doc_id").eqNullSafe(F.col("_again_id")) & (F.col("_sha") == F.col("_again_sha")), "left_semi")
    row = F.struct(*names)
    one = repeated.groupBy("doc_id", "_sha").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return _unpacked(_gone(left, again).select(*names).unionByName(one), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; the others go by id and text.

    Texts without words, null ones too, link with nothing and stay. Null ids go where their
    group has an id. Repeated rows of what stays stay. Other columns, of any names, pass
    through. An empty table gives an empty one.
    """
    rows, _ = _packed(docs)
    gone = jaccard_components(docs, choose=True).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    return _unpacked(_gone(rows.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), gone), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: shard after shard, each ordered by a hash and cut into as many files as its size asks for.

    A null source is one of its own; null texts have no words and go with their block; null
    and repeated ids are drawn row by row. Other columns, of any names, pass through. An empty table gives an empty one.
    """
    rows, names = _packed(docs)
    drawn = mix_sources(rows.withColumn("source", F.col(names[docs.columns.index("source")])), keep=tuple(names)).withColumn("draw", F.explode("draws"))
    place = "draw.shard", "draw.shuffle_key"  # by ranges: a task's rows don't depend on the number of shards
    return _unpacked(drawn.repartitionByRange(*place).sortWithinPartitions(*place), docs, "k_")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to: ``doc_id, n_tokens, ids, decoded_sha256``.

    Null texts count as empty; null and repeated ids pass through. An empty table gives an empty one.
    """
    return encode_documents(docs, default_path(), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: SQL expresses neither the language model nor the mix: a test compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
