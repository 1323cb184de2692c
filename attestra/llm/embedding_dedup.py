"""Near-duplicate embeddings by binary codes of random rotations, with stored correction factors.

Equal vectors are one node. A node's unit vector is turned by two independent random rotations
(into more dimensions where it has few); the signs are its two codes, and each code keeps its
correction factors: f, the inner product of the vector with its code, and r, the length of what
the code has beside the vector, over f. Two vectors' inner product is estimated from one's
first code and the other's second: <code, code> / (f f). The rotations are independent and
what the codes have beside the vectors points anywhere, so the estimate has no bias, and its
deviation follows from both r.

The first code is also the index: its bits are cut into ``tables`` bands, and vectors that
share a band meet in a bucket. Bits and number of bands follow from the number of vectors and
from the recall that a pair at the threshold must have; farther pairs need no recall, nearer ones
have more. In a bucket only codes are compared. A pair whose estimate and bound stay below the
threshold is done with; the others are the pairs that get their exact cosine, in a second
step that alone sees vectors. A pair is looked at in the first band that it shares, so that
counts of links need no list of pairs: buckets give a count for each node and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import join_uses, table, written
from attestra.llm.components import components

LEAST_BITS = 256  # of a code
BUCKET = 256  # vectors that meet in a bucket by chance
BLOCK = 1_024  # rows of a block of a bucket; two blocks are compared in one task
PAIRS = 1 << 16  # pairs compared at a time
BROADCAST_ROWS = 400_000
LEFT, RIGHT = 1, 2


def index_shape(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands. A bit agrees with probability 1 - angle / pi."""
    bits = min(32, max(1, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    p = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**bits)))


def rotations(size: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent random frames: ``bits`` x ``size``, orthonormal columns."""
    made = []
    for s in (seed, seed + 1):
        q, r = np.linalg.qr(np.random.default_rng([s, size, bits]).standard_normal((bits, size)))
        made.append(q * np.sign(np.diag(r)))
    return made[0], made[1]


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of length 1 in double precision, shorter ones filled with zeros."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), size))
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of bytes of one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start = column.offset * width
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(len(column), width)


class Codes:
    """Codes of some vectors: ``bits`` of the first code, and what estimates need."""

    def __init__(self, cell: pa.Table, frames: tuple[np.ndarray, np.ndarray]):
        wide = len(frames[0])
        number = lambda c: cell.column(c).to_numpy()[:, None].astype(np.float32)
        self.bits = np.unpackbits(_bytes(cell.column("code_1"), wide // 8), axis=1)
        both = self.bits, np.unpackbits(_bytes(cell.column("code_2"), wide // 8), axis=1)
        decoded = [(b.astype(np.float32) * 2 - 1) @ frame.astype(np.float32) / (np.float32(math.sqrt(wide)) * number(f)) for b, frame, f in zip(both, frames, ("f_1", "f_2"), strict=True)]
        self.first, self.second = decoded
        self.rest = np.maximum(number("r_1"), number("r_2"))[:, 0] ** 2

    def open_pairs(self, side: np.ndarray, threshold: float, epsilon: float, bits: int, tables: int, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a left and a right row, each once, that may reach the threshold and share no band before ``band``."""
        size = self.first.shape[1]
        left, right = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
        found = []
        step = max(1, 8 * PAIRS // max(1, len(right)))
        for i in range(0, len(left), step):
            a = left[i : i + step]
            estimate = (self.first[a] @ self.second[right].T + self.second[a] @ self.first[right].T) / 2
            ra, rb = self.rest[a][:, None], self.rest[right][None, :]
            bound = epsilon * np.sqrt(((1 - threshold**2) * (ra + rb) + ra * rb) / max(1, size - 1))
            p, q = np.nonzero(estimate + bound >= threshold)
            p, q = a[p], right[q]
            once = (p < q) | (side[p] & RIGHT == 0) | (side[q] & LEFT == 0)
            p, q = p[once & (p != q)], q[once & (p != q)]
            for k in range(0, len(p), PAIRS) if band else ():
                x, y = p[k : k + PAIRS], q[k : k + PAIRS]
                differ = (self.bits[x, : band * bits] != self.bits[y, : band * bits]).reshape(len(x), band, bits).any(axis=2)
                fresh = differ.all(axis=1)
                found.append((x[fresh], y[fresh]))
            if not band:
                found.append((p, q))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place reaches by the links ``a, b``."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.999, epsilon: float = 5.0, seed: int = 0) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link at cosine >= ``threshold``, in double precision. ``n_links`` counts the other
    rows linked directly, equal vectors among them; ``component_id`` is the smallest id
    reachable by links, the row's own included; ``kept`` marks the rows of that id. ``recall``:
    the least chance that a pair at the threshold is found, over the random rotations; equal
    vectors are always found, and nothing below the threshold links. ``epsilon``: deviations
    that the bound of an estimate spans.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with
    nothing; vectors of different lengths neither. Rows that repeat an id are rows of their
    own. Null ids link like others and are never the smallest; a component of null ids only
    has a null ``component_id`` and keeps them all. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good, odd = rows.where(sound), rows.where(~sound)
    nodes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    count, size = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    links = _linked(nodes, count, size or 1, threshold, recall, epsilon, seed)
    roots = components(links.where("`to` IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(sums, "node", "left").join(roots, "node", "left").select("vector", "copies", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    known = written(known, "linked")
    least = written(known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "least")
    known = written(join_uses(known.select("vector", "copies", "n_links", "root"), least, ["root"], "nodes").select("vector", "copies", "n_links", "component_id"), "linked")
    found = join_uses(good, known, ["vector"], "copies").select("vec_id", "n_links", "component_id").unionByName(odd.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(nodes: DataFrame, count: int, size: int, threshold: float, recall: float, epsilon: float, seed: int) -> DataFrame:
    """``node, links, to`` of the nodes of each bucket that link there: rows linked, and a node of the same component."""
    bits, tables = index_shape(count, threshold, recall)
    wide = -(-max(size, LEAST_BITS, bits * tables) // 8) * 8
    frames = nodes.sparkSession.sparkContext.broadcast(rotations(size, wide, seed))

    def encode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = unit_vectors(part.column(1), size)
                columns, first = [], None
                for frame in frames.value:
                    turned = x @ frame.T
                    f = np.abs(turned).sum(axis=1) / math.sqrt(wide)
                    code = turned > 0
                    first = code if first is None else first
                    beside = (code * 2.0 - 1) @ frame / math.sqrt(wide) - f[:, None] * x
                    packed = np.packbits(code, axis=1).tobytes()
                    columns += [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * (wide // 8), wide // 8, dtype=np.int32)), pa.py_buffer(packed)])]
                    columns += [pa.array(f.astype(np.float32)), pa.array((np.linalg.norm(beside, axis=1) / f).astype(np.float32))]
                powers = 1 << np.arange(bits, dtype=np.int64)
                band = first[:, : bits * tables].reshape(len(x), tables, bits) @ powers
                length = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                keys = (length[:, None] * tables + np.arange(tables)) << 32 | band
                keys = pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * tables, tables, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, keys], names=["node", "code_1", "f_1", "r_1", "code_2", "f_2", "r_2", "keys"])

    codes = "code_1 binary, f_1 float, r_1 float, code_2 binary, f_2 float, r_2 float"
    coded = written(nodes.select("node", "vector").mapInArrow(encode, f"node long, {codes}, keys array<long>"), "codes")
    placed = coded.select("node", F.explode("keys").alias("key"))
    large = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    few = large.count() <= BROADCAST_ROWS
    names = [c.split()[0] for c in codes.split(", ")]
    rows = coded.select("node", *names, F.explode("keys").alias("key")).join(F.broadcast(large) if few else large, "key", "left")
    # A bucket of one block is a cell; of a larger one, every two blocks are, and every block with itself.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j"), F.when(o == block, LEFT | RIGHT).when(block < o, LEFT).otherwise(RIGHT).alias("side")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(LEFT | RIGHT).alias("side")))
    cells = rows.withColumn("c", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(others))).select("key", "c.*", "node", *names)

    def open_rows(cell: pa.Table) -> pa.Table:
        """The rows of a cell that some pair needs again."""
        side, key = cell.column("side").to_numpy(), cell.column("key")[0].as_py()
        a, b = Codes(cell, frames.value).open_pairs(side, threshold, epsilon, bits, tables, (key >> 32) % tables)
        return cell.select(["key", "i", "j", "side", "node"]).take(pa.array(np.union1d(a, b)))

    opened = written(cells.groupBy("key", "i", "j").applyInArrow(open_rows, "key long, i int, j int, side int, node long"), "open")

    def linked(cell: pa.Table) -> pa.Table:
        """Links of a cell by exact cosines."""
        side, key = cell.column("side").to_numpy(), cell.column("key")[0].as_py()
        a, b = Codes(cell, frames.value).open_pairs(side, threshold, epsilon, bits, tables, (key >> 32) % tables)
        x, copies, node = unit_vectors(cell.column("vector").combine_chunks(), size), cell.column("copies").to_numpy(), cell.column("node").to_numpy()
        near = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + PAIRS]], x[b[k : k + PAIRS]]) >= threshold for k in range(0, len(a), PAIRS)] or [np.zeros(0, bool)])
        a, b = a[near], b[near]
        links = (np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))).astype(np.int64)
        root, some = _forest(len(x), a, b), links > 0
        to = pa.array(node[root], mask=root == np.arange(len(x)))
        return pa.table({"node": pa.array(node), "links": pa.array(links), "to": to}).filter(pa.array(some))

    again = opened.join(coded.select("node", *names), "node").join(nodes.select("node", "vector", "copies"), "node").select("key", "i", "j", "side", "node", *names, "vector", "copies")
    return written(again.groupBy("key", "i", "j").applyInArrow(linked, "node long, links long, `to` long"), "links")


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
    SELECT vec_id, row_number() OVER () AS i, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.i AS x, b.i AS y FROM e a JOIN e b ON a.i <> b.i AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT i AS x, i AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT r.x, min(e.vec_id) AS component_id FROM r JOIN e ON e.i = r.y GROUP BY r.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM e JOIN c ON c.x = e.i LEFT JOIN n ON n.x = e.i
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE NOT coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
"""
