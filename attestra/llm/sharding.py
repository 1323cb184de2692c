"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Units of equal text are points with a weight in bytes and three coordinates: size, first
id and source. A node is split along the dimension in which its points are spread widest
(as a part of the whole table's spread), at the weighted median, or for an odd number of
leaves at the quantile that leaves every leaf the target bytes. The median is found by
distributed histograms: each pass sums the weights of ``BINS`` bins of every open node
and narrows on the bin that holds the median, so a pass sends nodes x bins sums to the
driver however large the table is. Hash bits below each coordinate break ties, so that
millions of points with one coordinate can still be cut anywhere.

Law: ``bytes``. Copies of a text share a shard, unless together they weigh more than
``split_share`` of a leaf: such a hot group is dealt row by row, since no shard could hold
it and stay near its target.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from attestra.llm.common import table, written

BINS, PASSES = 1024, 3
COORD_BITS, TIE_BITS = 16, 36
DIMENSIONS = ("_d0", "_d1", "_d2")
ROWS_A_BUCKET = 50_000


@dataclass
class Node:
    """``leaves`` shards from ``first`` on; ``low``/``high`` and ``at`` narrow on the cut."""

    leaves: int
    first: int
    weight: int = 0
    units: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    dimension: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    before_units: int = 0
    done: bool = False


def _coordinate(value: Column, low: Column, high: Column) -> Column:
    """0 to 2^COORD_BITS - 1 between the table's extremes; 0 where all values agree or there is none."""
    share = F.try_divide((value - low).cast("double"), (high - low).cast("double"))
    return F.coalesce(F.floor(F.least(share, F.lit(1.0)) * (2**COORD_BITS - 1)), F.lit(0)).cast("long")


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, split_share: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit, and units with weight and keys."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.crc32(F.encode(F.coalesce(F.col(source_col), F.lit("")), "UTF-8")).alias("_source"),
    )
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("_text").agg(F.sum("size").alias("w")).where(F.col("w") > F.lit(split_share * total / shards)).select("_text", F.lit(True).alias("_hot"))
    # Each hot group weighs more than split_share of a leaf: there are fewer than shards / split_share of them.
    rows = rows.join(F.broadcast(heavy), "_text", "left").withColumn("_unit", F.when(F.col("_hot"), F.xxhash64("_text", "doc_id")).otherwise(F.col("_text")))
    units = rows.groupBy("_unit").agg(F.sum("size").alias("w"), F.min("doc_id").alias("id"), F.min("_source").alias("source"), F.max("size").alias("size"))
    ends = rows.agg(F.min("size"), F.max("size"), F.min("doc_id"), F.max("doc_id"), F.min("_source"), F.max("_source")).first()
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(7), "_unit"), 64 - TIE_BITS)
    keys = [
        (F.shiftleft(_coordinate(value, low, high), TIE_BITS) + tie).alias(d)
        for d, value, low, high in zip(
            DIMENSIONS,
            (F.log2("size"), F.coalesce(F.col("id"), F.lit(0)), F.col("source")),
            (F.log2(F.lit(ends[0])), F.lit(ends[2]), F.lit(ends[4])),
            (F.log2(F.lit(ends[1])), F.lit(ends[3]), F.lit(ends[5])),
            strict=True,
        )
    ]
    return rows, written(units.select("_unit", "w", *keys), "shard-units")


def _walk(cuts: dict[int, tuple[int, int]], leaf: dict[int, int], node: int = 1) -> Column:
    """One nested CASE that walks the tree; children of node i are 2i and 2i + 1."""
    if node not in cuts:
        return F.lit(leaf.get(node, node))
    d, cut = cuts[node]
    return F.when(F.col(DIMENSIONS[d]) < cut, _walk(cuts, leaf, 2 * node)).otherwise(_walk(cuts, leaf, 2 * node + 1))


def _narrow(units: DataFrame, open_: dict[int, Node]) -> None:
    """One histogram pass for all open nodes."""
    spark = units.sparkSession
    at = [(i, n.dimension, n.low, max(1, -(-(n.high - n.low) // BINS))) for i, n in open_.items()]
    # At most one row for each open node, fewer than the shards.
    listed = ", ".join(f"({i}, {d}, {low}L, {step}L)" for i, d, low, step in at)
    state = F.broadcast(spark.sql(f"SELECT * FROM VALUES {listed} AS t(_node, _dim, _low, _step)"))
    key = F.element_at(F.array(*DIMENSIONS), F.col("_dim") + 1)
    bins = units.join(state, "_node").withColumn("bin", F.floor((key - F.col("_low")) / F.col("_step")).cast("long")).where((F.col("bin") >= 0) & (F.col("bin") < BINS))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in bins.groupBy("_node", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r["_node"], {})[r["bin"]] = (r["w"], r["n"])
    for i, _, low, step in at:
        n, want = open_[i], open_[i].weight * (open_[i].leaves // 2) / open_[i].leaves
        for b in sorted(found.get(i, {})):
            w, c = found[i][b]
            if n.before + w >= want:
                break
            n.before, n.before_units = n.before + w, n.before_units + c
        whole = n.before + w - want < want - n.before
        n.low, n.high = low + b * step, low + (b + 1) * step
        n.done = c == 1 or step == 1
        n.extra = (w, c, whole)


def _settle(n: Node, i: int, cuts: dict, nodes: dict[int, Node]) -> None:
    """Cut at the nearer edge of the last bin; leaves follow the weights on either side."""
    w, c, whole = n.extra
    if (whole and n.before_units + c < n.units) or not n.before_units:
        cut, left, left_units = n.high, n.before + w, n.before_units + c
    else:
        cut, left, left_units = n.low, n.before, n.before_units
    cuts[i] = (n.dimension, cut)
    k = round(n.leaves * left / n.weight) if n.weight else n.leaves // 2
    k = max(1, min(n.leaves - 1, k))
    if n.units >= n.leaves:  # no leaf without a unit
        k = max(n.leaves - (n.units - left_units), min(k, left_units), 1)
    nodes[2 * i] = Node(k, n.first)
    nodes[2 * i + 1] = Node(n.leaves - k, n.first + k)


def kd_shards(units: DataFrame, shards: int) -> DataFrame:
    """Units with their ``shard``."""
    nodes, cuts, depth = {1: Node(shards, 0)}, {}, 0
    while any(n.leaves > 1 for i, n in nodes.items() if i.bit_length() == depth + 1):
        at = units.withColumn("_node", _walk(cuts, {}))
        level = {i: n for i, n in nodes.items() if i.bit_length() == depth + 1 and n.leaves > 1}
        ends = [x for d in DIMENSIONS for x in (F.min(d), F.max(d))]
        for r in at.where(F.col("_node").isin(list(level))).groupBy("_node").agg(F.sum("w"), F.count(F.lit(1)), *ends).collect():
            n = level[r[0]]
            n.weight, n.units, n.spans = r[1], r[2], [(r[3 + 2 * d], r[4 + 2 * d]) for d in range(len(DIMENSIONS))]
        open_ = {i: n for i, n in level.items() if n.units > 1}
        for n in open_.values():
            n.dimension = max(range(len(DIMENSIONS)), key=lambda d, n=n: ((n.spans[d][1] >> TIE_BITS) - (n.spans[d][0] >> TIE_BITS), -d))
            n.low, n.high = n.spans[n.dimension][0], n.spans[n.dimension][1] + 1
        for _ in range(PASSES):
            if left := {i: n for i, n in open_.items() if not n.done}:
                _narrow(at, left)
        for i, n in open_.items():
            _settle(n, i, cuts, nodes)
        depth += 1
    leaf = {i: n.first for i, n in nodes.items() if i not in cuts}
    return units.select("_unit", _walk(cuts, leaf).cast("int").alias("shard"))


def shard_by_kd_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 40, split_share: float = 1.0) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes and 16 more; null text counts as empty. ``slot`` runs
    from 0 without gaps in each shard. Null sources are one source, null ids count as 0.
    With fewer distinct texts than shards some shards stay empty; an empty table gives an
    empty result. Rows that repeat an id and a text share a shard. Other columns are not read.
    """
    rows, units = _units(docs, id_col, text_col, source_col, shards, split_share)
    # A shuffled join on the unit: no unit weighs more than split_share of a leaf.
    placed = written(rows.join(kd_shards(units, shards), "_unit").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    # Slots by buckets of bounded size: numbers within a bucket, after those of the buckets before it.
    buckets = max(1, placed.count() // (shards * ROWS_A_BUCKET) * 2)
    bucketed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = bucketed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "_b", (F.sum("n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")) - 1
    return bucketed.join(before, ["shard", "_b"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + inside).cast("long").alias("slot"))


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_kd_tree(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
