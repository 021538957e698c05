"""Ratio estimators over ``(num, den)`` pairs: sums, medians, outliers, bootstrap intervals, coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.bits import order_bits
from plumbline.functions.stats import SHORT_BITS, SHORT_DRAWS, digest_weight, poisson_weight, with_digest, with_draw, with_short_draws
from plumbline.operators.ordering import with_dense_index, with_prior_sums
from plumbline.operators.quantiles import medians, order_statistics
from plumbline.session import fan_out

# Outlier factor, size bands of a text in characters, strata of a collection.
OUTLIER_FACTOR = 5.0
SIZE_BANDS = (("curto", 1000), ("médio", 4000))
LAST_BAND = "longo"
SIDE = 5  # replicates of one row that are summed side by side
STRATA, STRATUM_MIN, COLLECT_TARGET = ("acentuado", "codigo", "ascii"), 30, 300


def valid_samples(df: DataFrame, conditions: Sequence[str] | None = None, num: str = "num", den: str = "den") -> DataFrame:
    """Real samples of a known condition with both sides of the ratio present and non-zero."""
    ok = ~F.coalesce("dry_run", F.lit(False)) & (F.coalesce(num, F.lit(0)) != 0) & (F.coalesce(den, F.lit(0)) != 0)
    return df.filter(ok & F.col("condition").isin(*conditions)) if conditions else df.filter(ok & F.col("condition").isNotNull())


def with_group_median(df: DataFrame, value: str, by: Sequence[str], out: str = "median") -> DataFrame:
    m = medians(df.select(*by, value), value, by).select(*by, F.col("median").alias(out))
    return df.join(m, list(by), "left")


def drop_outliers(df: DataFrame, by: str = "condition", value: str = "total", factor: float = OUTLIER_FACTOR) -> DataFrame:
    """Keep rows up to ``factor`` times their group's median; an absent value counts as zero."""
    filled = df.withColumn("_v", F.coalesce(value, F.lit(0.0)))
    return with_group_median(filled, "_v", [by], "_m").filter(F.col("_v") <= F.col("_m") * factor).drop("_v", "_m")


def discard_report(df: DataFrame, by: str = "condition", value: str = "total", factor: float = OUTLIER_FACTOR) -> DataFrame:
    filled = df.withColumn("_v", F.coalesce(value, F.lit(0.0)))
    out = F.col("_v") > F.col("_m") * factor
    return (
        with_group_median(filled, "_v", [by], "_m")
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(out).alias("n_discarded"))
        .withColumn("discard_share", F.col("n_discarded") / F.col("n_raw"))
    )


def ratio_of_sums(df: DataFrame, num: str = "num", den: str = "den", by: Sequence[str] = (), on_zero: str = "error") -> DataFrame:
    """Sum over sum, which weighs an observation by its size; a zero denominator is an error or null."""
    sums = df.groupBy(*by).agg(
        F.sum(F.col(num).cast("double")).alias("num"), F.sum(F.col(den).cast("double")).alias("den"), F.count(F.lit(1)).alias("n")
    )
    zero = F.raise_error(F.lit("aggregated denominator is zero")).cast("double") if on_zero == "error" else F.lit(None).cast("double")
    return sums.withColumn("ratio", F.when(F.col("den") == 0, zero).otherwise(F.col("num") / F.col("den")))


def dose_check(df: DataFrame, reference: str, value: str = "den", by: str = "condition") -> DataFrame:
    """Median per condition and its ratio to the reference condition's."""
    m = medians(df.select(by, value), value, [by])
    ref = m.filter(F.col(by) == reference).select(F.col("median").alias("_ref"))
    return m.join(ref, how="left").select(
        by, "n", "median", F.coalesce(F.col("median") / F.nullif(F.col("_ref"), F.lit(0.0)), F.lit(0.0)).alias("dose")
    )


def spike_fraction(df: DataFrame, value: str, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """Share of rows above ``factor`` times the overall median; one row."""
    rows = df.select(F.coalesce(value, F.lit(0.0)).alias("v"))
    m = medians(rows, "v").select("median")
    return rows.crossJoin(m).groupBy("median").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > factor * F.col("median")).alias("spikes")
    ).withColumn("share", F.col("spikes") / F.col("n"))


def missing_by_condition(valid: DataFrame, conditions: Sequence[str], expected: int) -> DataFrame:
    """Expected minus valid samples per declared condition, zero-sample conditions included."""
    counts = valid.agg(*[F.count_if(F.col("condition") == c).alias(f"_{i}") for i, c in enumerate(conditions)])
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"_{i}").alias("n")) for i, c in enumerate(conditions)])
    return counts.select(F.explode(rows).alias("r")).select("r.condition", "r.n", (F.lit(expected) - F.col("r.n")).alias("missing"))


def bootstrap_replicates(
    df: DataFrame, by: Sequence[str] = (), num: str = "num", den: str = "den", key: str = "key", b: int = 2000, seed: int = 0
) -> DataFrame:
    """``(by, b, num, den, n)`` sums of ``b`` Poisson-bootstrap replicates that resample pairs.

    The weight of a row in a replicate comes from a digest of (seed, key, replicate) of its own, so partitioning and retries
    change nothing. ``SIDE`` replicates are summed side by side; each task adds its rows into groups x b sums before the shuffle.
    """
    names = [f"_w{i}" for i in range(SIDE)]
    weighted = _spread(df, by, num, den, key, -(-b // SIDE))
    for i, n in enumerate(names):
        weighted = with_digest(weighted, "_k", F.col("_g") * SIDE + i, seed, n)
    # No filter on the weights: pushed below the projections it would repeat the whole draw.
    return _weighted_sums(weighted.withColumns({n: digest_weight(F.col(n)).cast("double") for n in names}), by, names, b)


def short_replicates(
    df: DataFrame, by: Sequence[str] = (), num: str = "num", den: str = "den", key: str = "key", b: int = 2000, seed: int = 0
) -> DataFrame:
    """``bootstrap_replicates`` with draws of 20 bits, six of them from one digest: faster, and coarser in the weights' law."""
    names = [f"_w{i}" for i in range(SHORT_DRAWS)]
    drawn = with_short_draws(_spread(df, by, num, den, key, -(-b // SHORT_DRAWS)), "_k", "_g", seed, names)
    return _weighted_sums(drawn.withColumns({n: poisson_weight(F.col(n), SHORT_BITS).cast("double") for n in names}), by, names, b)


def _spread(df: DataFrame, by: Sequence[str], num: str, den: str, key: str, blocks: int) -> DataFrame:
    """Every row once for each block ``_g`` of replicates."""
    rows = df.select(*by, F.col(num).cast("double").alias("_a"), F.col(den).cast("double").alias("_d"), F.col(key).cast("string").alias("_k"))
    return fan_out(rows, "_k").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _weighted_sums(weighted: DataFrame, by: Sequence[str], names: Sequence[str], b: int) -> DataFrame:
    sums = [F.sum(x).alias(f"_{label}{i}") for i, n in enumerate(names) for label, x in (("a", F.col(n) * F.col("_a")), ("d", F.col(n) * F.col("_d")), ("n", F.col(n)))]
    rows = F.array(*[
        F.struct((F.col("_g") * len(names) + i).alias("b"), F.col(f"_a{i}").alias("num"), F.col(f"_d{i}").alias("den"), F.col(f"_n{i}").cast("long").alias("n"))
        for i in range(len(names))
    ])
    return weighted.groupBy(*by, "_g").agg(*sums).select(*by, F.explode(rows).alias("r")).select(*by, "r.*").filter(F.col("b") < b)


def exact_replicates(
    df: DataFrame, by: Sequence[str] = (), num: str = "num", den: str = "den", order: str = "key", b: int = 2000, seed: int = 0
) -> DataFrame:
    """Replicates that draw exactly n pairs with replacement, as a join of draws on row position.

    Writes n x b draws per group, so it suits the small samples of a single run; the Poisson form
    has no such cost.
    """
    groups = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    placed = with_dense_index(rows.select(*groups, order, F.col(num).cast("double").alias("_a"), F.col(den).cast("double").alias("_d")), order, groups)
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    slots = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn(
        "_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    )
    draws = (
        with_draw(slots, "_j", "b", seed, "_u")
        .withColumn("idx", F.col("_u") % F.col("_n"))
        .groupBy(*groups, "b", "idx")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    return (
        draws.join(placed, [*groups, "idx"])
        .groupBy(*groups, "b")
        .agg(F.sum(F.col("_w") * F.col("_a")).alias("num"), F.sum(F.col("_w") * F.col("_d")).alias("den"), F.sum("_w").alias("n"))
        .drop("_all")
    )


def percentile_interval(replicates: DataFrame, value: Column, by: Sequence[str] = (), conf: float = 0.90) -> DataFrame:
    """Order statistics ``floor(alpha m)`` and ``floor((1 - alpha) m)`` of the defined replicate values.

    Nothing is interpolated. A window holds at most the number of replicates.
    """
    alpha = (1.0 - conf) / 2.0
    groups = list(by) or ["_all"]
    rows = (replicates if by else replicates.withColumn("_all", F.lit(0))).withColumn("_x", value).filter("_x IS NOT NULL")
    w = Window.partitionBy(*groups)
    ranked = rows.select(
        *groups, "_x", (F.row_number().over(w.orderBy("_x")) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("_m")
    )
    lo = F.greatest(F.lit(0), F.floor(F.lit(alpha) * F.col("_m")))
    hi = F.least(F.col("_m") - 1, F.floor(F.lit(1.0 - alpha) * F.col("_m")))
    return ranked.groupBy(*groups).agg(
        F.max(F.when(F.col("_r") == lo, F.col("_x"))).alias("lo"), F.max(F.when(F.col("_r") == hi, F.col("_x"))).alias("hi"),
        F.max("_m").alias("n_replicates"),
    ).drop("_all")


def _ratio(num: str = "num", den: str = "den") -> Column:
    return F.col(num) / F.nullif(F.col(den), F.lit(0.0))


def bootstrap_ratio(df: DataFrame, by: Sequence[str] = (), b: int = 2000, conf: float = 0.90, seed: int = 0, exact: bool = False, **cols) -> DataFrame:
    """Percentile interval of the ratio of sums per group; an empty group has no row."""
    make = exact_replicates if exact else bootstrap_replicates
    return percentile_interval(make(df, by, b=b, seed=seed, **cols), _ratio(), by, conf)


def bootstrap_ratio_of_ratios(
    df: DataFrame, reference: str, by: str = "condition", b: int = 2000, conf: float = 0.95, seed: int = 0, **cols
) -> DataFrame:
    """Interval of each condition's ratio over the reference's, the conditions resampled independently."""
    reps = bootstrap_replicates(df, [by], b=b, seed=seed, **cols).withColumn("r", _ratio())
    ref = reps.filter(F.col(by) == reference).select("b", F.col("r").alias("r_ref"))
    paired = reps.filter(F.col(by) != reference).join(ref, "b")
    return percentile_interval(paired, F.col("r") / F.nullif(F.col("r_ref"), F.lit(0.0)), [by], conf)


def bootstrap_prop_diff(
    df: DataFrame, group: str, first: str, second: str, flag: str, key: str = "key", b: int = 2000, alpha: float = 0.05, seed: int = 0,
    make: Callable[..., DataFrame] = bootstrap_replicates,
) -> DataFrame:
    """Difference of two proportions (second - first) with an interpolated percentile interval."""
    ones = df.filter(F.col(group).isin(first, second)).select(group, key, F.col(flag).cast("double").alias("num"), F.lit(1.0).alias("den"))
    reps = make(ones, [group], key=key, b=b, seed=seed).withColumn("p", _ratio())
    pair = reps.groupBy("b").agg(
        (F.max(F.when(F.col(group) == second, F.col("p"))) - F.max(F.when(F.col(group) == first, F.col("p")))).alias("d")
    )
    point = ones.agg(
        (F.avg(F.when(F.col(group) == second, F.col("num"))) - F.avg(F.when(F.col(group) == first, F.col("num")))).alias("diff"),
        F.coalesce(F.sum(F.when(F.col(group) == first, F.col("num"))), F.lit(0.0)).cast("long").alias("k1"),
        F.count_if(F.col(group) == first).alias("n1"),
        F.coalesce(F.sum(F.when(F.col(group) == second, F.col("num"))), F.lit(0.0)).cast("long").alias("k2"),
        F.count_if(F.col(group) == second).alias("n2"),
    )
    # The replicate table has b rows, so the built-in percentile is bounded by a parameter.
    bounds = pair.agg(F.percentile("d", alpha / 2).alias("lo"), F.percentile("d", 1 - alpha / 2).alias("hi"))
    return point.crossJoin(bounds)


def cluster_bootstrap(
    df: DataFrame, cluster: str, by: Sequence[str] = (), b: int = 2000, conf: float = 0.95, seed: int = 0, num: str = "num", den: str = "den"
) -> DataFrame:
    """Interval that resamples clusters (LONG key) instead of rows."""
    sums = df.groupBy(*by, cluster).agg(F.sum(F.col(num).cast("double")).alias("num"), F.sum(F.col(den).cast("double")).alias("den"))
    return bootstrap_ratio(sums, by, b, conf, seed, key=cluster)


Interval = Callable[[DataFrame, Sequence[str]], DataFrame]


def coverage(df: DataFrame, interval: Interval, reps: int, key: str = "key", seed: int = 1, num: str = "num", den: str = "den") -> DataFrame:
    """How often an interval holds the truth: one row with hit rate, its error and the mean width.

    The table is split by hash into ``reps`` disjoint samples whose known truth is the ratio of the
    whole table; ``interval(df, by)`` is any estimator that works per group, so all samples are
    scored in one job.
    """
    truth = df.agg((F.sum(F.col(num).cast("double")) / F.sum(F.col(den).cast("double"))).alias("truth"))
    parts = with_draw(df, key, 0, seed, "_u").withColumn("rep", F.col("_u") % reps).drop("_u")
    ci = interval(parts, ["rep"]).crossJoin(truth)
    hit = ((F.col("lo") <= F.col("truth")) & (F.col("truth") <= F.col("hi"))).cast("double")
    return (
        ci.agg(F.count(F.lit(1)).alias("reps"), F.avg(hit).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"))
        .withColumn("se", F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("reps")))
    )


def size_band(chars: Column | str) -> Column:
    c = F.col(chars) if isinstance(chars, str) else chars
    band = F.lit(LAST_BAND)
    for name, below in reversed(SIZE_BANDS):
        band = F.when(c < below, F.lit(name)).otherwise(band)
    return band


def ratio_by_band(df: DataFrame, by: Sequence[str], num: str = "num", den: str = "den") -> DataFrame:
    return ratio_of_sums(df.withColumn("band", size_band(num)), num, den, [*by, "band"], on_zero="null")


def with_average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of the exact ``value`` in its group; null where the value is.

    Equal values are merged before ranking, and running counts come from cells of the values' order-preserving bits, four
    levels of 2^16 each.
    """
    keyed = df.withColumn("_k", order_bits(value))
    sizes = keyed.filter("_k IS NOT NULL").groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"))
    ranks = with_prior_sums(sizes, "_k", ["_n"], by, levels=3).select(*by, "_k", (F.col("prior__n") + (F.col("_n") + 1) / 2).alias(out))
    return keyed.join(ranks, [*by, "_k"], "left").drop("_k")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group; descriptive only."""
    ranked = with_average_rank(with_average_rank(df.select(*by, x, y), x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def fraction_profile(df: DataFrame, num: str, den: str, ceiling: float) -> DataFrame:
    """Order statistics of num/den, the share at or above ``ceiling`` and the shape; one row.

    The shape is ``tail`` if the upper percent is far above the upper tenth while the middle is
    over the ceiling, ``uniform`` if only the middle is over it, else ``below``.
    """
    frac = df.select((F.coalesce(num, F.lit(0.0)) / F.coalesce(F.nullif(F.col(den), F.lit(0.0)), F.lit(1.0))).alias("f"))
    size = frac.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") >= ceiling).alias("n_over"))
    ranks = {
        m: lambda n, q=q: F.least(n - 1, F.floor(F.lit(q) * n))
        for m, q in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))
    }
    found = order_statistics(frac, "f", ranks).drop("n")
    shape = (
        F.when((F.col("p50") >= ceiling) & (F.col("p90") < F.col("p99") * 0.5), "tail").when(F.col("p50") >= ceiling, "uniform").otherwise("below")
    )
    return size.crossJoin(found).withColumn("share_over", F.col("n_over") / F.col("n")).withColumn("shape", shape)


def collection_progress(df: DataFrame, stratum: str = "classe", strata: Sequence[str] = STRATA, n_min: int = STRATUM_MIN,
                        target: int = COLLECT_TARGET) -> DataFrame:
    """Collected samples per declared stratum against its minimum; the ratio itself is never shown.

    Rows of other strata follow with a null ``missing``.
    """
    counts = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    declared = df.agg(*[F.count_if(F.col(stratum) == s).alias(f"_{i}") for i, s in enumerate(strata)])
    rows = F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(f"_{i}").alias("n")) for i, s in enumerate(strata)])
    inside = declared.select(F.explode(rows).alias("r")).select("r.*").withColumn("missing", F.greatest(F.lit(n_min) - F.col("n"), F.lit(0)))
    known = counts.sparkSession.createDataFrame([(s,) for s in strata], "stratum string")
    outside = counts.join(known, "stratum", "left_anti").withColumn("missing", F.lit(None).cast("long"))
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    return inside.unionByName(outside).crossJoin(total).withColumn("complete", F.col("n_total") >= target)


def population_cascade(events: DataFrame) -> DataFrame:
    """Valid telemetry population with the count left after each exclusion, in order."""
    token = F.coalesce(F.col("event") == "token_usage", F.lit(False))
    provider = token & F.coalesce(F.col("provider") == "anthropic", F.lit(False))
    regime = provider & F.col("format_state").isNotNull()
    complete = regime & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(token).alias("n_token_usage"), F.count_if(provider).alias("n_provider"),
        F.count_if(regime).alias("n_regime"), F.count_if(complete).alias("n_population"),
    )


def valid_population(events: DataFrame) -> DataFrame:
    return events.filter(
        (F.col("event") == "token_usage") & (F.col("provider") == "anthropic") & F.col("format_state").isNotNull()
        & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    )


def frequent_regimes(population: DataFrame, regime: str = "format_hash") -> DataFrame:
    return population.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.min("mode").alias("mode")).orderBy(F.desc("n"), regime)


def cost_metrics(samples: DataFrame, conditions: Sequence[str], expected: int, b: int = 2000, seed: int = 20260814) -> DataFrame:
    """The one-row input of the equivalence cost verdict.

    ``samples``: ``condition, dry_run, num (duration), den (tokens), load, total, key``; conditions in
    the order reference, control, half, double.
    """
    ref, control, half, double = conditions
    valid = valid_samples(samples, conditions)
    kept = drop_outliers(valid)
    r = bootstrap_ratio_of_ratios(kept, ref, b=b, seed=seed)
    loads = valid.withColumns({"num": F.coalesce("load", F.lit(0.0)), "den": F.lit(1.0)})
    rl = bootstrap_ratio_of_ratios(loads, ref, b=b, seed=seed).filter(F.col("condition") == double)
    dose = dose_check(kept, ref)
    live = samples.filter(~F.coalesce("dry_run", F.lit(False)))

    def at(c: str, x: str, out: str) -> Column:
        return F.max(F.when(F.col("condition") == c, F.col(x))).alias(out)

    missing = missing_by_condition(valid, conditions, expected).agg(F.sum(F.greatest("missing", F.lit(0))).alias("missing"))
    intervals = r.agg(
        at(control, "lo", "ctrl_lo"), at(control, "hi", "ctrl_hi"), at(half, "lo", "half_lo"), at(half, "hi", "half_hi"), at(double, "lo", "double_lo")
    )
    return (
        missing.crossJoin(intervals)
        .crossJoin(rl.agg(F.max("lo").alias("load_lo"), F.max("hi").alias("load_hi")))
        .crossJoin(dose.agg(at(half, "dose", "half_dose"), at(double, "dose", "double_dose")))
        .crossJoin(spike_fraction(live, "load").agg(F.max("share").alias("reload_share")))
        .crossJoin(discard_report(valid).agg(F.max("discard_share").alias("worst_discard")))
    )
