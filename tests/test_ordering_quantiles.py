"""Neighbours, positions, running sums and order statistics against plain Python."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from plumbline.functions.bits import order_bits
from plumbline.operators import ordering as O
from plumbline.operators import quantiles as Z
from plumbline.operators.claims import best_threshold
from plumbline.operators.ratios import with_average_rank


@pytest.fixture(scope="module")
def keyed(spark):
    rng = random.Random(5)
    keys = rng.sample(range(1 << 20), 400)
    return [(k, "g" + str(k % 3), float(k % 17)) for k in keys]


@pytest.mark.parametrize("bits,levels", [(16, 2), (4, 2), (3, 3), (30, 0)])
def test_neighbours_cross_cells(spark, keyed, bits, levels):
    df = spark.createDataFrame(keyed, "k long, g string, v double").repartition(7)
    nxt = {r.k: r.next and r.next.v for r in O.with_next(df, "k", ["v"], bits=bits, levels=levels).collect()}
    prv = {r.k: r.previous and r.previous.k for r in O.with_previous(df, "k", [], bits=bits, levels=levels).collect()}
    order = sorted(keyed)
    for i, (k, _g, _v) in enumerate(order):
        assert nxt[k] == (order[i + 1][2] if i + 1 < len(order) else None)
        assert prv[k] == (order[i - 1][0] if i else None)


@pytest.mark.parametrize("bits,levels", [(16, 2), (4, 2), (3, 3)])
def test_prior_sums_and_positions_per_group(spark, keyed, bits, levels):
    df = spark.createDataFrame(keyed, "k long, g string, v double")
    sums = {r.k: r.prior_v for r in O.with_prior_sums(df, "k", ["v"], ["g"], bits, levels).collect()}
    idx = {r.k: r.idx for r in O.with_dense_index(df, "k", ["g"], bits=bits, levels=levels).collect()}
    for g in ("g0", "g1", "g2"):
        total = 0.0
        for i, (k, _g, v) in enumerate(sorted(r for r in keyed if r[1] == g)):
            assert sums[k] == pytest.approx(total) and idx[k] == i
            total += v


def test_shift_neighbour_wraps(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "k long, t string")
    assert {r.k: r.neighbour.t for r in O.shift_neighbour(df, "k", ["t"]).collect()} == {10: "b", 20: "c", 30: "a"}


def test_medians(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(2001)] + [("b", float(rng.randint(0, 3))) for _ in range(1500)] + [("c", 7.0), ("d", None), (None, 1.5), (None, -2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r["median"], r.n) for r in Z.medians(df, "v", ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in ("a", "b", "c", None):
        own = [v for x, v in rows if x == g and v is not None]
        assert got[g] == (pytest.approx(statistics.median(own)), len(own))


def test_several_percentiles(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = Z.interpolated(df, "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    assert (row.p10, row.p50, row.p99) == (pytest.approx(99.9), pytest.approx(499.5), pytest.approx(989.01))
    assert Z.medians(df.limit(0), "v").count() == 0


def test_a_million_distinct_values_of_one_group(spark):
    # nearly equal values, so that the first digits tell nothing, with every rank exact
    df = spark.range(1_000_000).selectExpr("1000 + pmod(id * 7919, 1000000) / 1e9 AS v")
    ranks = {f"r{i}": lambda n, i=i: F.lit(i) for i in (0, 1, 499_999, 777_777, 999_999)}
    row = Z.order_statistics(df, "v", ranks).first()
    assert [row[f"r{i}"] for i in (0, 1, 499_999, 777_777, 999_999)] == [1000 + i / 1e9 for i in (0, 1, 499_999, 777_777, 999_999)]


EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 0.5, 1.2, 1.3, 1.4, 4.0]


def test_bits_have_the_order_of_doubles(spark):
    rng = random.Random(4)
    values = EXTREMES + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)] + [math.ldexp(1.0, e) * f for e in range(-1074, 1024, 7) for f in (1.0, math.nextafter(1.0, 2.0), math.nextafter(1.0, 0.0))]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bits = {r.v: r.b for r in df.select("v", order_bits("v").alias("b")).collect()}
    for v in values:
        own = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert bits[v] == (-own if v < 0 else own), v
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(order_bits("v").alias("b")).collect()
    assert nan[0].b > bits[float("inf")] and nan[1].b is None


def test_near_values_have_ranks_of_their_own(spark):
    rows = [("a", 1.2), ("a", 1.3), ("a", 1.4), ("a", 1.3), ("a", 1.3 + 2e-16), ("b", -1e-9), ("b", 1e-9), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = [(r.g, r.v, r.k) for r in with_average_rank(df, "v", "k", ["g"]).collect()]
    assert sorted(got, key=lambda r: (r[0], r[2] is None, r[2])) == [
        ("a", 1.2, 1.0), ("a", 1.3, 2.5), ("a", 1.3, 2.5), ("a", 1.3 + 2e-16, 4.0), ("a", 1.4, 5.0), ("b", -1e-9, 1.0), ("b", 1e-9, 2.0), ("b", None, None),
    ]


def test_threshold_between_near_scores(spark):
    df = spark.createDataFrame([(0.5, False), (0.5 + 1e-9, True), (0.5 + 2e-9, True)], "s double, truth boolean")
    row = best_threshold(df, "s").first()
    assert (row.cut, row.correct, row.n) == (0.5 + 1e-9, 3, 3)
