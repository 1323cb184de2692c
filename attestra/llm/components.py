"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import drop_written, hot_limit, join_uses, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge; ``root`` is the least node that it reaches.

    ``edges`` has two long columns ``a, b``; direction, repeats and loops don't matter. No
    edges give no rows. Each round is two aggregations and two joins on a node, written to
    the shared folder; a node with very many edges is pre-aggregated, and its edges are joined
    where they are. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.where("a <> b").select(a, b).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(new):
            break
        mark = tuple(new)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = both.groupBy("a").agg(F.count(F.lit(1)).alias("uses")).agg(F.max("uses")).first()[0] or 0
        kept = []

        def tied(rows: DataFrame, known: DataFrame) -> DataFrame:
            """Join on ``a``; where a node is hot, both tables are written and its edges joined where they are."""
            if most <= hot_limit(2 * new[0]):
                return rows.join(known.drop("uses"), "a")
            kept.append(written(known, "least"))
            return join_uses(rows, kept[-1], ["a"], "uses")

        uses = F.count(F.lit(1)).alias("uses")
        large = tied(both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), uses)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        if kept:
            large = written(large, "large")
            kept.append(large)
        small = tied(large, large.groupBy("a").agg(F.min("b").alias("m"), uses)).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        for gone in (now, *kept):
            drop_written(gone)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
