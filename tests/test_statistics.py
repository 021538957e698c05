"""Interval properties, partition independence and coverage."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ratios as R


def pairs(spark, n, noise=0.2, seed=1):
    rng = random.Random(seed)
    rows = [(i, 100.0 * (i % 7 + 1) * (1 + rng.uniform(-noise, noise)), 25.0 * (i % 7 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "key long, num double, den double")


def test_ratio_of_sums_is_not_a_mean_of_ratios(spark):
    df = spark.createDataFrame([(1000.0, 100.0), (10.0, 10.0)], "num double, den double")
    assert R.ratio_of_sums(df).first().ratio == pytest.approx(1010 / 110)


def test_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "num double, den double")
    assert R.ratio_of_sums(df, on_zero="null").first().ratio is None
    with pytest.raises(Exception, match="denominator"):
        R.ratio_of_sums(df).collect()


@pytest.mark.parametrize("exact", [False, True])
def test_interval_holds_the_point_and_narrows(spark, exact):
    widths = []
    for n in (50, 800):
        df = pairs(spark, n)
        ci, point = R.bootstrap_ratio(df, b=200, seed=3, exact=exact).first(), R.ratio_of_sums(df).first().ratio
        assert ci.lo <= point <= ci.hi
        widths.append(ci.hi - ci.lo)
    assert widths[1] < widths[0]


def test_no_variance_collapses(spark):
    ci = R.bootstrap_ratio(pairs(spark, 60, noise=0.0), b=100, seed=3).first()
    assert ci.lo == pytest.approx(4.0) and ci.hi == pytest.approx(4.0)


def test_partitioning_does_not_matter(spark):
    df = pairs(spark, 300)
    a = R.bootstrap_ratio(df.repartition(1), b=100, seed=9).first()
    b = R.bootstrap_ratio(df.repartition(13), b=100, seed=9).first()
    assert a.lo == pytest.approx(b.lo, rel=1e-12) and a.hi == pytest.approx(b.hi, rel=1e-12)


def test_coverage_is_near_nominal_and_drops_with_conf(spark):
    df = pairs(spark, 6000)
    wide = R.coverage(df, lambda d, by: R.bootstrap_ratio(d, by, 200, 0.90, 5), 100).first()
    thin = R.coverage(df, lambda d, by: R.bootstrap_ratio(d, by, 200, 0.01, 5), 100).first()
    assert 0.78 <= wide.coverage <= 0.98 and thin.coverage < 0.3


def test_ratio_of_ratios_finds_the_dose(spark):
    a = pairs(spark, 400).withColumn("condition", F.lit("base"))
    b = pairs(spark, 400, seed=2).select((F.col("key") + 1000).alias("key"), (F.col("num") * 2).alias("num"), "den").withColumn("condition", F.lit("dobro"))
    ci = R.bootstrap_ratio_of_ratios(a.unionByName(b), "base", b=300, seed=4).first()
    assert ci.lo < 2.0 < ci.hi and ci.lo > 1.8


def test_outliers_by_group_median(spark):
    rows = [("a", 1.0), ("a", 1.2), ("a", 9.0), ("b", 9.0), ("b", 8.0), ("b", None)]
    df = spark.createDataFrame(rows, "condition string, total double")
    assert sorted((r.condition, r.total) for r in R.drop_outliers(df).collect() if r.total) == [("a", 1.0), ("a", 1.2), ("b", 8.0), ("b", 9.0)]
    assert {r.condition: r.n_discarded for r in R.discard_report(df).collect()} == {"a": 1, "b": 0}


def test_progress_hides_the_ratio(spark):
    df = spark.createDataFrame([("ascii", 10, 3), ("outro", 1, 1)], "classe string, text_chars long, input_tokens long")
    out = R.collection_progress(df)
    assert not {"text_chars", "input_tokens", "usage", "payload_bytes"} & set(out.columns)
    assert {r.stratum: r.missing for r in out.collect()} == {"acentuado": 30, "codigo": 30, "ascii": 29, "outro": None}


def test_every_replicate_draws_sixty_bits_of_its_own_digest(spark):
    from hashlib import md5

    from plumbline.functions.stats import poisson_limits

    limits = poisson_limits()
    weight = lambda k, b: sum(int(md5(f"9:{k}:{b}".encode()).hexdigest()[:15], 16) >= v for v in limits)
    rows = [(f"k{i}", i + 1.0, 1.0) for i in range(40)]
    got = R.bootstrap_replicates(spark.createDataFrame(rows, "key string, num double, den double"), b=13, seed=9).collect()
    assert {r.b: (r.num, r.den, r.n) for r in got} == {
        b: (sum(weight(k, b) * a for k, a, _ in rows), *2 * (sum(weight(k, b) for k, _, _ in rows),)) for b in range(13)
    }
