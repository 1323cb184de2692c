"""Exact quantiles of large groups by counting digits; cuts of a key into even ranges.

A double becomes a 64-bit integer of the same order. A first pass counts the leading digits of
each group, a row for each task and digit; the digits that hold the wanted ranks are kept, and
the next pass counts the next digits of the values that share them, until each digit left holds
one value. The values of a group never meet in one task, and what a pass sends depends on
groups and digits, not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.sources.tables import materialised

SHIFTS = (46, 34, 22, 11, 0)  # what is left of a number after each digit: 18 bits first, with sign and exponent
FEW = 2_048  # values of a digit that the next pass tells apart at once
BROADCAST_ROWS = 200_000


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)  # exact for whole exponents


def ordered(x: Column) -> Column:
    """A double as a long of the same order: sign, exponent and fraction. -0.0 is 0.0; NaN is the greatest, as in sorts."""
    a = F.abs(x)
    near = F.floor(F.log2(a))  # may be one off beside a power of two
    e = F.greatest(near + F.when(a >= _power(near + 1), 1).when(a < _power(near), -1).otherwise(0), F.lit(-1022))
    bits = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(0x7FF << 52))
        .when(a < 2.0**-1022, (a / 2.0**-1074).cast("long"))
        .otherwise(((e + 1023) * F.lit(1 << 52) + ((a / _power(e) - 1) * 2.0**52).cast("long")).cast("long"))
    )
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -bits).otherwise(bits)


def restored(key: Column) -> Column:
    """The double of an ``ordered`` long."""
    bits = F.abs(key)
    e, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1))
    a = F.when(e >= 0x7FF, F.lit(float("inf"))).when(e == 0, fraction * F.lit(2.0**-1074)).otherwise((1 + fraction / 2.0**52) * _power(e - 1023))
    return F.when(key == (1 << 63) - 1, F.lit(float("nan"))).when(key < 0, -a).otherwise(a)


def quantiles(rows: DataFrame, group: tuple[str, ...], values: dict[str, Column], at: tuple[float, ...], name: str = "stage") -> DataFrame:
    """``group, name, n, mean, q`` for each group and each of the named values: ``q`` has the quantiles ``at``, linearly interpolated.

    Null values don't count; a group without values has no row. Null is a group. NaN is the
    greatest value, and infinities are values. An empty table gives an empty result; other
    columns are not read. ``rows`` is read once for each pass, two to five times.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items())))
    keyed = rows.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), each.alias("x")).where("x.v IS NOT NULL")
    keyed = keyed.select(*(f"g{i}" for i in range(len(group))), "x.name", "x.v", ordered(F.col("x.v")).alias("key"))
    own = [*(f"g{i}" for i in range(len(group))), "name"]
    counted = [F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")]
    bins = materialised(keyed.groupBy(*own, F.shiftright("key", SHIFTS[0]).alias("bin")).agg(*counted, F.sum("v").alias("sum")))
    places = [(F.col("total") - 1) * q for q in at]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in places))))
    running = Window.partitionBy(*own).orderBy("bin")
    first = bins.withColumns({"total": F.sum("n").over(Window.partitionBy(*own)), "before": F.sum("n").over(running) - F.col("n")})
    found = materialised(_holding(first.withColumn("ranks", ranks)))
    resolved = [found.where("lo = hi")]
    open_ = found.where("lo <> hi")
    for last, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        many = open_.count()
        if not many:
            break
        wanted = open_.select(*(F.col(c).alias(f"w_{c}") for c in own), F.col("bin").alias("w_bin"), F.col("before").alias("w_before"), F.col("n").alias("w_n"), F.col("ranks").alias("w_ranks"))
        same = F.shiftright("key", last) == F.col("w_bin")
        for c in own:
            same &= F.col(c).eqNullSafe(F.col(f"w_{c}"))
        inside = keyed.join(F.broadcast(wanted) if many <= BROADCAST_ROWS else wanted, same)
        digit = F.when(F.col("w_n") <= FEW, F.col("key")).otherwise(F.shiftright("key", shift))
        bins_ = inside.groupBy(*own, "w_bin", digit.alias("bin")).agg(*counted, F.first("w_before").alias("start"), F.first("w_ranks").alias("ranks"))
        w = Window.partitionBy(*own, "w_bin").orderBy("bin")
        found = materialised(_holding(bins_.withColumn("before", F.col("start") + F.sum("n").over(w) - F.col("n"))))
        resolved.append(found.where("lo = hi"))
        open_ = found.where("lo <> hi")
    hits = resolved[0].select(*own, "ranks", "lo")
    for more in resolved[1:]:
        hits = hits.unionByName(more.select(*own, "ranks", "lo"))
    known = hits.select(*own, F.explode("ranks").alias("rank"), restored(F.col("lo")).alias("v")).groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at_rank"))
    totals = bins.groupBy(*own).agg(F.sum("n").alias("total"), (F.sum("sum") / F.sum("n")).alias("mean"))
    on = F.lit(True)
    for c in own:
        on &= totals[c].eqNullSafe(known[c])
    joined = totals.join(known, on).select(*(totals[c].alias(c) for c in own), "total", "mean", "at_rank")
    value = lambda p: F.try_element_at("at_rank", p.cast("long"))
    q = F.array(*(F.when(value(F.floor(p)) == value(F.ceil(p)), value(F.floor(p))).otherwise(value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * (p - F.floor(p))) for p in places))
    return joined.select(*(F.col(f"g{i}").alias(g) for i, g in enumerate(group)), F.col("name").alias(name), F.col("total").alias("n"), "mean", q.alias("q"))


def _holding(bins: DataFrame) -> DataFrame:
    """The bins with a wanted rank, and which ones."""
    inside = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return bins.withColumn("ranks", inside).where(F.size("ranks") > 0)


def even_cuts(rows: DataFrame, key: str, parts: int) -> list[float]:
    """Values of a numeric key that cut its rows into ``parts`` ranges of near equal numbers of rows."""
    found = quantiles(rows, (), {"key": F.col(key)}, tuple(i / parts for i in range(1, parts))).first()
    return sorted(set(found["q"])) if found else []
