"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source is cut into the same number of hash blocks; one aggregation gives the
   words of each block. Only these sums (sources x blocks rows) reach the driver.
2. A source's target is its weight's share of ``total_share`` of all words, stopped at
   ``max_repeats`` times its words, the excess shared again by weight. A target is some
   whole passes over the source and a part of one more: whole blocks in a permuted order,
   and of one boundary block the documents below a hash threshold found by two histograms.
3. The block draws of all sources are dealt to the output shards by a binary tree: each
   node splits its vector of source quotas by one multivariate-hypergeometric draw, so
   that shards hold equally many blocks and the quotas are met exactly.
4. A shard takes the next permuted blocks of each source, disjoint from other shards'
   draws, and orders its rows by a hash: the local shuffle.

Everything is seeded; a rerun gives the same mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import local_table, table, word_count, written

FINE_BITS = 12
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
    total_share: float = 1.5
    max_repeats: int = 2
    blocks: int = 256
    shards: int = 16
    seed: int = 42


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words to take of each source, sources in their order."""
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    caps = [float(mix.max_repeats * s) for s in sizes]
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, mix.total_share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > caps[i]}
        for i in over or open_:
            out[i] = caps[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(caps[i] for i in over)
        open_ -= over
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Quotas of each shard: a tree of multivariate-hypergeometric draws."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals") if quotas.sum() else quotas
    return [*split_quotas(drawn, left, rng), *split_quotas(quotas - drawn, shards - left, rng)]


def nearest_cut(sums: dict[int, int], want: float, bins: int) -> tuple[int, float]:
    """The last bin to take whole comes before the returned one; what is then still wanted."""
    for b in range(bins):
        if sums.get(b, 0) > want:
            return b, want
        want -= sums.get(b, 0)
    return bins, want


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, draws``, and the columns named in ``keep`` as ``k_...``.

    ``draws`` is an array of ``(pass, shard, shuffle_key)``, one for each time the mix takes
    the document; empty if it doesn't. ``size`` counts words; null text has none. Null is a
    source of its own, the last. A source without words has target 0, and its documents and
    other empty ones ride along with their block. Blocks and thresholds hash the id; null and
    repeated ids are rows of their own by the text too, and where texts repeat as well by the
    place in the input (a rerun over the same files agrees). An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key.alias("_source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(mix.seed), F.col(id_col)).alias("_hash"),
        F.xxhash64(F.col(text_col)).alias("_text"),
        F.monotonically_increasing_id().alias("_place"),
        *(F.col(c).alias(f"k_{c}") for c in keep),
    )
    base = written(given.drop(*(f"k_{c}" for c in keep)), "mix")
    counts = base.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("n")).groupBy("_hash").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    again = written(counts.where("rows > 1").select("_hash", (F.col("most") > 1).alias("_by_place")), "mix-repeats")
    repeats = again.count()
    if repeats and keep:
        given = written(given, "mix-rows")  # a row has one place

    def hashed(rows: DataFrame) -> DataFrame:
        u = F.col("_hash")
        if repeats:
            rows = rows.join(F.broadcast(again) if repeats <= BROADCAST_ROWS else again, "_hash", "left")
            u = F.when(F.col("_by_place").isNull(), u).when(F.col("_by_place"), F.xxhash64("_hash", "_text", "_place")).otherwise(F.xxhash64("_hash", "_text"))
        return rows.withColumn("_hash", u).withColumns({"_block": F.pmod("_hash", F.lit(mix.blocks)).cast("int"), "_fine": F.shiftrightunsigned("_hash", 64 - 2 * FINE_BITS)})

    base, given = hashed(given.drop(*(f"k_{c}" for c in keep)) if repeats and keep else base), hashed(given)
    rows = base.groupBy("_source", "_block").agg(F.sum("size").alias("words")).collect()  # sources x blocks sums
    plan, rest = _block_plan(rows, mix)
    plan = _with_thresholds(base, plan, rest)
    schema = "_source string, _block int, source_size long, target double, _whole array<struct<pass:int,shard:int>>, _part array<struct<pass:int,shard:int>>, _below long"
    planned = local_table(spark, plan, schema)
    taken = F.when(F.col("_fine") < F.col("_below"), F.concat("_whole", "_part")).otherwise(F.col("_whole"))
    # Keyed by source and block: a source with a third of all rows is spread over all its blocks.
    if len(plan) <= BROADCAST_ROWS:  # beyond it both sides are shuffled
        planned = F.broadcast(planned)
    return (given if keep else base).join(planned, ["_source", "_block"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(mix.seed + 1), F.col("_hash"), d["pass"]).alias("shuffle_key"))).alias("draws"),
        *(f"k_{c}" for c in keep),
    )


def _block_plan(rows: list, mix: Mix) -> tuple[list[list], dict[str, tuple[int, float]]]:
    """Plan rows by source and block, and of each source the boundary block and the words wanted of it."""
    words: dict[str, dict[int, int]] = {}
    for r in rows:
        words.setdefault(r["_source"], {})[r["_block"]] = r["words"]
    names = sorted(words, key=lambda s: (s == "n", s))
    sizes = [sum(words[s].values()) for s in names]
    wanted = targets(sizes, mix)
    rng = np.random.default_rng(mix.seed)
    draws, rest = [], {}
    for name, size, target in zip(names, sizes, wanted, strict=True):
        blocks = sorted(words[name])
        whole, left = (int(target // size), target - size * (target // size)) if size else (0, 0.0)
        own = [(p, b) for p in range(whole) for b in rng.permutation(blocks).tolist()]
        boundary = None
        if left > 0:
            for b in rng.permutation(blocks).tolist():
                if words[name][b] <= left:  # blocks that still fit, in the permuted order
                    own.append((whole, b))
                    left -= words[name][b]
                elif boundary is None:
                    boundary = b
        if boundary is not None and left > 0:
            rest[name] = (boundary, left)
            own.append((whole, boundary))
        draws.append(own if size else [])
    shard_of: list[list[int]] = [[] for _ in names]
    for shard, quota in enumerate(split_quotas(np.array([len(d) for d in draws], dtype=np.int64), mix.shards, rng)):
        for i, n in enumerate(quota.tolist()):
            shard_of[i] += [shard] * n
    plan = []
    for i, name in enumerate(names):
        dealt: dict[int, tuple[list, list]] = {b: ([], []) for b in words[name]}
        part = len(draws[i]) - 1 if name in rest else -1
        for k, ((p, b), shard) in enumerate(zip(draws[i], shard_of[i], strict=True)):
            dealt[b][k == part].append((p, shard))
        plan += [[name, b, sizes[i], wanted[i], w, x, 0] for b, (w, x) in dealt.items()]
    return plan, rest


def _with_thresholds(base: DataFrame, plan: list[list], rest: dict[str, tuple[int, float]]) -> list[list]:
    """Of each boundary block, the hash below which its documents are taken, by two histograms of 2^FINE_BITS bins."""
    if not rest:
        return plan
    spark, bins = base.sparkSession, 1 << FINE_BITS
    low, want = {s: 0 for s in rest}, {s: w for s, (_, w) in rest.items()}
    for shift in (FINE_BITS, 0):
        at = local_table(spark, [(s, b, low[s], low[s] + (bins << shift)) for s, (b, _) in rest.items()], "_source string, _block int, _low long, _high long")
        inside = base.join(at, ["_source", "_block"]).where("_fine >= _low AND _fine < _high")
        sums: dict[str, dict[int, int]] = {}
        for r in inside.groupBy("_source", F.expr(f"shiftright(_fine - _low, {shift})").cast("int").alias("bin")).agg(F.sum("size").alias("words")).collect():
            sums.setdefault(r["_source"], {})[r["bin"]] = r["words"]
        for s in rest:
            own = sums.get(s, {})
            cut, left = nearest_cut(own, want[s], bins)
            if not shift and cut < bins and own[cut] - left < left:  # one bin more comes nearer
                cut += 1
            low[s], want[s] = low[s] + (cut << shift), left
    return [[*row[:-1], low[row[0]]] if row[5] else row for row in plan]


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    # Besides the contract's columns, where each take goes: its shard, and its place there by the shuffle key.
    takes = F.transform("draws", lambda d: d["shard"]), F.transform("draws", lambda d: d["shuffle_key"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), takes[0].alias("shards"), takes[1].alias("shuffle_keys"))
