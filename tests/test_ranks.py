"""Exact quantiles by digits against sorted values."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from attestra.operators import ranks

AT = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
ODD = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0, math.nextafter(2, 0), 1.7976931348623157e308, -1.7976931348623157e308, 4503599627370497.5, 0.1, -0.1, 2.0**1023, math.nextafter(2.0**1023, 0), float("inf"), float("-inf")]


def plain(values, q):
    s = sorted(values)
    p = (len(s) - 1) * q
    a, b = s[math.floor(p)], s[math.ceil(p)]
    return a if a == b else a + (b - a) * (p - math.floor(p))


def test_ordered_is_the_bits_and_comes_back(spark):
    r = random.Random(1)
    values = ODD + [struct.unpack("<d", struct.pack("<q", r.getrandbits(63) - (r.getrandbits(1) << 63)))[0] for _ in range(20_000)] + [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)]
    values += [math.nextafter(2.0**e, w) for e in range(-1000, 1023) for w in (0, math.inf)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.ordered(F.col("v")).alias("k")).select("v", "k", ranks.restored(F.col("k")).alias("back")).collect()
    for x in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(x.v)))[0]
        assert x.k == (bits if x.v >= 0 else -bits)
        assert x.back == x.v
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(ranks.ordered(F.col("v")).alias("k"), ranks.restored(ranks.ordered(F.col("v"))).alias("b")).first()
    assert nan.k == (1 << 63) - 1
    assert math.isnan(nan.b)


@pytest.mark.parametrize("few", [2_048, 3])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    r = random.Random(few)
    groups = {"hot": [r.lognormvariate(3, 5) * r.choice([1, -1]) for _ in range(4000)], None: [float(r.randrange(9)) for _ in range(500)], "one": [3.5], "odd": ODD, "close": [1 + r.randrange(50) * 2.0**-52 for _ in range(900)]}
    rows = [(g, v, None if i % 3 else v * 2, "x") for g, vs in groups.items() for i, v in enumerate(vs)] + [("none", None, None, "x")]
    found = ranks.quantiles(spark.createDataFrame(rows, "g string, v double, w double, bin string").repartition(5), ("g",), {"v": F.col("v"), "w": F.col("w")}, AT, "name").collect()
    got = {(x.g, x.name): x for x in found}
    assert set(got) == {(g, n) for g in groups for n in "vw"}
    for g, vs in groups.items():
        for name, own in (("v", vs), ("w", [2 * v for i, v in enumerate(vs) if i % 3 == 0])):
            x = got[g, name]
            assert x.n == len(own)
            for q, v in zip(AT, x.q, strict=True):
                want = plain(own, q)
                assert v == want or math.isnan(v) and math.isnan(want) or v == pytest.approx(want, rel=1e-12)


def test_quantiles_of_no_rows(spark):
    rows = spark.createDataFrame([], "g string, v double")
    assert ranks.quantiles(rows, ("g",), {"v": F.col("v")}, AT).collect() == []
    assert ranks.even_cuts(rows, "v", 4) == []


def test_no_group_meets_in_one_task(spark):
    """A pass sends a row for each task and digit: far fewer than the group's rows, whatever its size."""
    rows = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") % 997 + F.rand(3)).alias("v"))
    before = {s.stageId for s in _stages(spark)}
    ranks.quantiles(rows, ("g",), {"v": F.col("v")}, (0.5,)).collect()
    written = [s.shuffleWriteRecords for s in _stages(spark) if s.stageId not in before]
    assert 0 < max(written) < 20_000


def _stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [type("S", (), {"stageId": found.apply(i).stageId(), "shuffleWriteRecords": found.apply(i).shuffleWriteRecords()}) for i in range(found.size())]


def test_even_cuts(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    cuts = ranks.even_cuts(rows, "k", 4)
    parts = [0, 0, 0, 0]
    for i in range(1000):
        parts[sum(c <= i * i for c in cuts)] += 1
    assert parts == [250, 250, 250, 250]
