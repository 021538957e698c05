"""Queries on ratio estimators, intervals and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.functions.stats import DRAW_BITS, SHORT_BITS, SHORT_DRAWS, poisson_limits, within
from plumbline.operators import ratios as R
from plumbline.plans import studies

B, SEED = 100, 7


def line_pairs(spark, sf_dir):
    """Price over quantity per order line; the key numbers the lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("num"), F.col("l_quantity").alias("den"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), F.col("l_orderkey").alias("cluster"),
    )


LINES_SQL = """lines AS (SELECT l_returnflag AS condition, l_extendedprice AS num, l_quantity AS den,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, l_orderkey AS cluster FROM lineitem)"""


def draw_sql(key, rep, seed):
    """The draw of a key in a replicate."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR) || ':' || CAST({rep} AS VARCHAR)), 1, {DRAW_BITS // 4}) AS BIGINT)"


def weights_sql(source, keep, key="key", b=B, seed=SEED):
    """CTEs that give every row of ``source`` its Poisson weight in every replicate."""
    limits = poisson_limits()
    case = "CASE " + " ".join(f"WHEN u < {v} THEN {i}" for i, v in enumerate(limits)) + f" ELSE {len(limits)} END"
    return f"""drawn AS (SELECT {keep}, num, den, b, {draw_sql(key, 'b', seed)} AS u FROM {source} CROSS JOIN generate_series(0, {b - 1}) g(b)),
    weighted AS (SELECT *, {case} AS w FROM drawn)"""


def short_weights_sql(source, keep, key="key", b=B, seed=SEED):
    """The same by draws of 20 bits, six of them from one digest."""
    limits = poisson_limits(SHORT_BITS, 10)
    case = "CASE " + " ".join(f"WHEN u < {v} THEN {i}" for i, v in enumerate(limits)) + f" ELSE {len(limits)} END"
    each = DRAW_BITS // SHORT_BITS
    half = f"CAST('0x' || substr(digest, 1 + {DRAW_BITS // 4} * (b % {SHORT_DRAWS} // {each}), {DRAW_BITS // 4}) AS BIGINT)"
    return f"""digests AS (SELECT {keep}, num, den, b, md5('{seed}:' || CAST({key} AS VARCHAR) || ':' || CAST(b // {SHORT_DRAWS} AS VARCHAR)) AS digest
      FROM {source} CROSS JOIN generate_series(0, {b - 1}) g(b)),
    drawn AS (SELECT {keep}, num, den, b, ({half} >> ({SHORT_BITS} * (b % {each}))) & {(1 << SHORT_BITS) - 1} AS u FROM digests),
    weighted AS (SELECT *, {case} AS w FROM drawn)"""


def interval_sql(source, by, value, conf):
    alpha = (1.0 - conf) / 2.0
    return f"""ranked AS (SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS r,
      count(*) OVER (PARTITION BY {by}) AS m FROM {source} WHERE {value} IS NOT NULL),
    interval_ AS (SELECT {by}, max(x) FILTER (r = greatest(0, floor({alpha!r} * m))) AS lo,
      max(x) FILTER (r = least(m - 1, floor({1.0 - alpha!r} * m))) AS hi FROM ranked GROUP BY {by})"""


@query(
    "ratio_of_sums",
    f"""WITH {LINES_SQL} SELECT condition, round(sum(num), 2) AS num, round(sum(den), 2) AS den, count(*) AS n, round(sum(num) / sum(den), 6) AS ratio
    FROM lines GROUP BY condition""",
)
def _(spark, sf_dir):
    out = R.ratio_of_sums(line_pairs(spark, sf_dir), by=["condition"])
    return rounded(out.withColumns({"num": F.round("num", 2), "den": F.round("den", 2)}))


REPS_SQL = f"""WITH {LINES_SQL}, {weights_sql('lines', 'condition')},
reps AS (SELECT condition, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY condition, b)"""


@query(
    "bootstrap_replicates",
    f"""WITH {LINES_SQL}, {weights_sql('lines', 'condition')}
    SELECT condition, b, round(sum(w * num), 2) AS num, round(sum(w * den), 2) AS den, CAST(sum(w) AS BIGINT) AS n FROM weighted GROUP BY condition, b""",
)
def _(spark, sf_dir):
    out = R.bootstrap_replicates(line_pairs(spark, sf_dir), ["condition"], b=B, seed=SEED)
    return rounded(out.withColumns({"num": F.round("num", 2), "den": F.round("den", 2)}))


@query(
    "bootstrap_ratio_interval",
    f"{REPS_SQL}, {interval_sql('reps', 'condition', 'v', 0.90)} SELECT condition, round(lo, 6) AS lo, round(hi, 6) AS hi, {B}::BIGINT AS n_replicates FROM interval_",
)
def _(spark, sf_dir):
    return rounded(R.bootstrap_ratio(line_pairs(spark, sf_dir), ["condition"], B, 0.90, SEED))


@query(
    "bootstrap_ratio_of_ratios",
    f"""{REPS_SQL}, rel AS (SELECT x.condition, x.v / y.v AS q FROM reps x JOIN reps y USING (b) WHERE y.condition = 'A' AND x.condition <> 'A'),
    {interval_sql('rel', 'condition', 'q', 0.95)}
    SELECT condition, round(lo, 6) AS lo, round(hi, 6) AS hi, lo >= 0.9 AND hi <= 1.1 AS equivalent FROM interval_""",
)
def _(spark, sf_dir):
    ci = R.bootstrap_ratio_of_ratios(line_pairs(spark, sf_dir), "A", b=B, seed=SEED)
    return rounded(ci.select("condition", "lo", "hi", within("lo", "hi", 0.10).alias("equivalent")))


@query(
    "bootstrap_clustered",
    f"""WITH {LINES_SQL}, clusters AS (SELECT condition, cluster AS key, sum(num) AS num, sum(den) AS den FROM lines GROUP BY ALL),
    {weights_sql('clusters', 'condition')}, reps AS (SELECT condition, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY condition, b),
    {interval_sql('reps', 'condition', 'v', 0.95)} SELECT condition, round(lo, 6) AS lo, round(hi, 6) AS hi FROM interval_""",
)
def _(spark, sf_dir):
    return rounded(R.cluster_bootstrap(line_pairs(spark, sf_dir), "cluster", ["condition"], B, 0.95, SEED).drop("n_replicates"))


@query(
    "bootstrap_proportion_difference",
    f"""WITH flags AS (SELECT event_type AS condition, event_id AS key, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END AS num, 1.0::DOUBLE AS den
      FROM events WHERE event_type IN ('click', 'view')), {weights_sql('flags', 'condition')},
    reps AS (SELECT b, sum(w * num) FILTER (condition = 'view') / sum(w) FILTER (condition = 'view')
                      - sum(w * num) FILTER (condition = 'click') / sum(w) FILTER (condition = 'click') AS d FROM weighted GROUP BY b)
    SELECT round((SELECT avg(num) FILTER (condition = 'view') - avg(num) FILTER (condition = 'click') FROM flags), 6) AS diff,
           (SELECT CAST(sum(num) FILTER (condition = 'click') AS BIGINT) FROM flags) AS k1, (SELECT count(*) FILTER (condition = 'click') FROM flags) AS n1,
           (SELECT CAST(sum(num) FILTER (condition = 'view') AS BIGINT) FROM flags) AS k2, (SELECT count(*) FILTER (condition = 'view') FROM flags) AS n2,
           round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM reps""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("event_id").alias("key"), (F.col("value") > 50).alias("flag"))
    return rounded(R.bootstrap_prop_diff(e, "condition", "click", "view", "flag", b=B, seed=SEED))


COVER_REPS = 40


@query(
    "interval_coverage",
    f"""WITH pairs AS (SELECT event_id AS key, value AS num, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS den FROM events),
    parts AS (SELECT key, num, den, {draw_sql('key', '0', 1)} % {COVER_REPS} AS rep FROM pairs),
    {weights_sql('parts', 'rep')}, reps AS (SELECT rep, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY rep, b),
    {interval_sql('reps', 'rep', 'v', 0.90)}, t AS (SELECT sum(num) / sum(den) AS truth FROM pairs),
    h AS (SELECT count(*) AS reps, avg(CASE WHEN truth BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(hi - lo) AS w FROM interval_, t)
    SELECT reps, round(coverage, 6) AS coverage, round(w, 6) AS mean_width, round(sqrt(coverage * (1 - coverage) / reps), 6) AS se FROM h""",
)
def _(spark, sf_dir):
    """The events split into disjoint samples by hash; the truth is the ratio of all events."""
    pairs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), F.col("value").alias("num"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("den")
    )
    return rounded(R.coverage(pairs, lambda d, by: R.bootstrap_ratio(d, by, B, 0.90, SEED), COVER_REPS))


def cost_samples(spark, sf_dir):
    """Events as paired measurements: four conditions, doses and a load time set by rule."""
    k = F.get_json_object("props", "$.k").cast("double")
    cond = F.when(F.col("event_type") == "click", "base_A").when(F.col("event_type") == "view", "base_B").when(
        F.col("event_type") == "error", "meio"
    ).when(F.col("event_type") == "purchase", "dobro").otherwise("outra")
    factor = F.when(cond == "meio", 1.5).when(cond == "dobro", 2.0).otherwise(1.0)
    return table(spark, sf_dir, "events").select(
        cond.alias("condition"), (F.col("user_id") == 13).alias("dry_run"), ((200 + k) * factor * (100 + k)).alias("num"), ((200 + k) * factor).alias("den"),
        (10 + k / 100).alias("load"), F.col("value").alias("total"), F.col("event_id").alias("key"),
    )


COST_SQL = """samples AS (SELECT CASE event_type WHEN 'click' THEN 'base_A' WHEN 'view' THEN 'base_B' WHEN 'error' THEN 'meio' WHEN 'purchase' THEN 'dobro' ELSE 'outra' END AS condition,
   user_id = 13 AS dry_run, (200 + k) * f * (100 + k) AS num, (200 + k) * f AS den, 10 + k / 100 AS load, value AS total, event_id AS key
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE event_type WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END::DOUBLE AS f FROM events)),
valid AS (SELECT * FROM samples WHERE NOT dry_run AND num <> 0 AND den <> 0 AND condition IN ('base_A', 'base_B', 'meio', 'dobro')),
limits AS (SELECT condition, median(total) * 5 AS lim FROM valid GROUP BY 1),
kept AS (SELECT v.* FROM valid v JOIN limits USING (condition) WHERE total <= lim)"""
CONDITIONS = ("base_A", "base_B", "meio", "dobro")


@query(
    "cost_outlier_discards",
    f"""WITH {COST_SQL} SELECT condition, count(*) AS n_raw, count(*) FILTER (total > lim) AS n_discarded,
    round(count(*) FILTER (total > lim) / count(*), 6) AS discard_share FROM valid JOIN limits USING (condition) GROUP BY condition""",
)
def _(spark, sf_dir):
    return rounded(R.discard_report(R.valid_samples(cost_samples(spark, sf_dir), CONDITIONS)))


@query("cost_samples_kept", f"WITH {COST_SQL} SELECT key, condition, round(num, 4) AS num, den FROM kept")
def _(spark, sf_dir):
    kept = R.drop_outliers(R.valid_samples(cost_samples(spark, sf_dir), CONDITIONS))
    return kept.select("key", "condition", F.round("num", 4).alias("num"), "den")


@query(
    "cost_dose_check",
    f"""WITH {COST_SQL}, m AS (SELECT condition, count(*) AS n, median(den) AS median FROM kept GROUP BY 1)
    SELECT condition, n, median, round(median / (SELECT median FROM m WHERE condition = 'base_A'), 6) AS dose FROM m""",
)
def _(spark, sf_dir):
    return rounded(R.dose_check(R.drop_outliers(R.valid_samples(cost_samples(spark, sf_dir), CONDITIONS)), "base_A"))


@query(
    "cost_reload_spikes",
    f"""WITH {COST_SQL}, v AS (SELECT total FROM samples WHERE NOT dry_run), m AS (SELECT median(total) AS median FROM v)
    SELECT round(median, 6) AS median, count(*) AS n, count(*) FILTER (total > 5 * median) AS spikes, round(count(*) FILTER (total > 5 * median) / count(*), 6) AS share
    FROM v, m GROUP BY median""",
)
def _(spark, sf_dir):
    return rounded(R.spike_fraction(cost_samples(spark, sf_dir).filter("NOT dry_run"), "total"))


@query(
    "cost_missing_samples",
    f"WITH {COST_SQL} SELECT condition, count(*) AS n, 2000 - count(*) AS missing FROM valid GROUP BY condition",
)
def _(spark, sf_dir):
    return rounded(R.missing_by_condition(R.valid_samples(cost_samples(spark, sf_dir), CONDITIONS), CONDITIONS, 2000))


@query(
    "verdict_cost_equivalence",
    f"""WITH {COST_SQL}, {weights_sql('kept', 'condition', b=B, seed=SEED)}, reps AS (SELECT condition, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY condition, b),
    rel AS (SELECT x.condition, x.v / y.v AS q FROM reps x JOIN reps y USING (b) WHERE y.condition = 'base_A' AND x.condition <> 'base_A'),
    {interval_sql('rel', 'condition', 'q', 0.95)}, m AS (
    SELECT (SELECT lo FROM interval_ WHERE condition = 'base_B') AS ctrl_lo, (SELECT hi FROM interval_ WHERE condition = 'base_B') AS ctrl_hi,
           (SELECT lo FROM interval_ WHERE condition = 'dobro') AS double_lo)
    SELECT round(ctrl_lo, 6) AS ctrl_lo, round(ctrl_hi, 6) AS ctrl_hi, round(double_lo, 6) AS double_lo,
           CASE WHEN double_lo > 1.0 THEN 'H1 CONFIRMADA, H2 NAO (sem dose-resposta separada)' ELSE 'H0 NAO REJEITADA (instrumento nao resolve 2x)' END AS verdict FROM m""",
)
def _(spark, sf_dir):
    """The rule-made samples pass every sanity check, so the confirmatory step decides."""
    m = R.cost_metrics(cost_samples(spark, sf_dir), CONDITIONS, 1, B, SEED)
    return rounded(studies.cost_verdict_equivalence(m).select("ctrl_lo", "ctrl_hi", "double_lo", "verdict"))


@query(
    "verdict_cost_overlap",
    f"""WITH {COST_SQL}, {weights_sql('kept', 'condition', b=B, seed=SEED)}, reps AS (SELECT condition, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY condition, b),
    {interval_sql('reps', 'condition', 'v', 0.95)}
    SELECT round((SELECT lo FROM interval_ WHERE condition = 'base_A'), 6) AS a_lo, round((SELECT hi FROM interval_ WHERE condition = 'base_A'), 6) AS a_hi,
           round((SELECT lo FROM interval_ WHERE condition = 'dobro'), 6) AS d_lo,
           CASE WHEN (SELECT median(load / total) FROM samples WHERE NOT dry_run) >= 0.01 THEN 'SANIDADE FALHOU (recarga de modelo)' ELSE '?' END AS verdict""",
)
def _(spark, sf_dir):
    s = cost_samples(spark, sf_dir)
    valid = R.valid_samples(s, CONDITIONS)
    kept = R.drop_outliers(valid)
    at = lambda c, x, out: F.max(F.when(F.col("condition") == c, F.col(x))).alias(out)
    ci = R.bootstrap_ratio(kept, ["condition"], B, 0.95, SEED).agg(
        at("base_A", "lo", "a_lo"), at("base_A", "hi", "a_hi"), at("base_B", "lo", "b_lo"), at("base_B", "hi", "b_hi"), at("dobro", "lo", "d_lo")
    )
    profile = R.fraction_profile(s.filter("NOT dry_run"), "load", "total", studies.LOAD_SHARE_MAX).select(F.col("p50").alias("median_load_share"))
    dose = R.dose_check(kept, "base_A").agg(at("dobro", "dose", "load_ratio"))
    worst = R.discard_report(valid).agg(F.max("discard_share").alias("worst_discard"))
    return rounded(
        studies.cost_verdict_overlap(ci.crossJoin(profile).crossJoin(dose).crossJoin(worst)).select("a_lo", "a_hi", "d_lo", "verdict")
    )


@query(
    "load_fraction_profile",
    """WITH f AS (SELECT l_tax * l_quantity / l_quantity AS f FROM lineitem), s AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS r, count(*) OVER () AS n FROM f)
    SELECT max(n) AS n, count(*) FILTER (f >= 0.05) AS n_over, round(max(f) FILTER (r = 0), 6) AS "min", round(max(f) FILTER (r = least(n - 1, floor(0.5 * n))), 6) AS p50,
      round(max(f) FILTER (r = least(n - 1, floor(0.9 * n))), 6) AS p90, round(max(f) FILTER (r = least(n - 1, floor(0.99 * n))), 6) AS p99, round(max(f), 6) AS "max",
      round(count(*) FILTER (f >= 0.05) / count(*), 6) AS share_over,
      CASE WHEN max(f) FILTER (r = least(n - 1, floor(0.5 * n))) < 0.05 THEN 'below' ELSE 'uniform' END AS shape FROM s""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * F.col("l_quantity")).alias("a"), F.col("l_quantity").alias("b"))
    return rounded(R.fraction_profile(lines, "a", "b", 0.05))


def token_events(spark, sf_dir):
    """Documents as telemetry: characters, a token count by rule, provider and format by source."""
    ok = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(ok % 9 == 0, "mode_switched").otherwise("token_usage").alias("event"), F.when(ok % 7 == 0, "ollama").otherwise("anthropic").alias("provider"),
        F.when(ok % 5 != 0, F.col("source")).alias("format_state"), F.col("source").alias("format_hash"), F.col("lang").alias("mode"),
        F.when(ok % 11 != 0, F.length("text") / 4 + 3).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.length("text").alias("text_chars"),
        F.when(F.col("lang") == "en", "ascii").when(F.col("lang") == "fr", "acentuado").otherwise(F.col("lang")).alias("classe"), ok.alias("key"),
    )


TOKENS_SQL = """ev AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'mode_switched' ELSE 'token_usage' END AS event, CASE WHEN doc_id % 7 = 0 THEN 'ollama' ELSE 'anthropic' END AS provider,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS format_state, source AS format_hash, lang AS mode, CASE WHEN doc_id % 11 <> 0 THEN length(text) / 4 + 3 END AS input_tokens,
  length(text) AS text_chars, CASE lang WHEN 'en' THEN 'ascii' WHEN 'fr' THEN 'acentuado' ELSE lang END AS classe, doc_id AS key FROM documents),
pop AS (SELECT * FROM ev WHERE event = 'token_usage' AND provider = 'anthropic' AND format_state IS NOT NULL AND input_tokens IS NOT NULL)"""


@query(
    "telemetry_cascade",
    f"""WITH {TOKENS_SQL} SELECT count(*) AS n_events, count(*) FILTER (event = 'token_usage') AS n_token_usage,
    count(*) FILTER (event = 'token_usage' AND provider = 'anthropic') AS n_provider,
    count(*) FILTER (event = 'token_usage' AND provider = 'anthropic' AND format_state IS NOT NULL) AS n_regime, (SELECT count(*) FROM pop) AS n_population FROM ev""",
)
def _(spark, sf_dir):
    return R.population_cascade(token_events(spark, sf_dir))


@query(
    "collection_progress",
    f"""WITH {TOKENS_SQL}, s AS (SELECT * FROM (VALUES ('acentuado'), ('codigo'), ('ascii')) v(stratum))
    SELECT stratum, n, CASE WHEN stratum IN (SELECT stratum FROM s) THEN greatest(30 - n, 0) END AS missing, (SELECT count(*) FROM pop) AS n_total, (SELECT count(*) FROM pop) >= 300 AS complete
    FROM (SELECT stratum, count(key) AS n FROM s FULL JOIN pop ON classe = stratum GROUP BY stratum HAVING stratum IS NOT NULL
          UNION ALL SELECT classe, count(*) FROM pop WHERE classe NOT IN (SELECT stratum FROM s) GROUP BY classe)""",
)
def _(spark, sf_dir):
    return rounded(R.collection_progress(R.valid_population(token_events(spark, sf_dir))))


@query("format_regimes", f"WITH {TOKENS_SQL} SELECT format_hash, count(*) AS n, min(mode) AS mode FROM pop GROUP BY 1")
def _(spark, sf_dir):
    return R.frequent_regimes(R.valid_population(token_events(spark, sf_dir)))


@query(
    "token_ratio_by_band",
    f"""WITH {TOKENS_SQL} SELECT classe, CASE WHEN text_chars < 1000 THEN 'curto' WHEN text_chars < 4000 THEN 'médio' ELSE 'longo' END AS band,
    round(sum(text_chars)::DOUBLE, 4) AS num, round(sum(input_tokens), 4) AS den, count(*) AS n, round(sum(text_chars) / sum(input_tokens), 6) AS ratio FROM pop GROUP BY ALL""",
)
def _(spark, sf_dir):
    return rounded(R.ratio_by_band(R.valid_population(token_events(spark, sf_dir)), ["classe"], "text_chars", "input_tokens"))


@query(
    "token_size_spearman",
    f"""WITH {TOKENS_SQL}, k AS (SELECT classe, text_chars AS x, text_chars / input_tokens AS y FROM pop),
    r AS (SELECT classe, rank() OVER (PARTITION BY classe ORDER BY x) + (count(*) OVER (PARTITION BY classe, x) - 1) / 2 AS rx,
                 rank() OVER (PARTITION BY classe ORDER BY y) + (count(*) OVER (PARTITION BY classe, y) - 1) / 2 AS ry FROM k)
    SELECT classe, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY classe""",
)
def _(spark, sf_dir):
    pop = R.valid_population(token_events(spark, sf_dir)).withColumn("r", F.col("text_chars") / F.col("input_tokens"))
    return rounded(R.spearman(pop, "text_chars", "r", ["classe"]))


@query(
    "verdict_token_ratio",
    f"""WITH {TOKENS_SQL}, p AS (SELECT classe, key, text_chars::DOUBLE AS num, input_tokens AS den FROM pop), {weights_sql('p', 'classe')},
    reps AS (SELECT classe, b, sum(w * num) / sum(w * den) AS v FROM weighted GROUP BY classe, b), {interval_sql('reps', 'classe', 'v', 0.90)},
    s AS (SELECT classe, count(*) AS n FROM p GROUP BY 1)
    SELECT classe, n, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN n < 30 THEN 'INDETERMINADO' WHEN lo >= 3.6 AND hi <= 4.4 THEN 'PASSA H0'
      WHEN hi < 3.6 OR lo > 4.4 THEN 'PASSA H1' ELSE 'INDETERMINADO' END AS verdict FROM s LEFT JOIN interval_ USING (classe)""",
)
def _(spark, sf_dir):
    pop = R.valid_population(token_events(spark, sf_dir)).select("classe", "key", F.col("text_chars").alias("num"), F.col("input_tokens").alias("den"))
    sizes = pop.groupBy("classe").agg(F.count(F.lit(1)).alias("n"))
    ci = R.bootstrap_ratio(pop, ["classe"], B, 0.90, SEED).drop("n_replicates")
    return rounded(studies.token_ratio_verdict(sizes.join(ci, "classe", "left")))


@query(
    "verdict_ablation_slice",
    f"""WITH flags AS (SELECT event_type AS condition, event_id AS key, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END AS num, 1.0::DOUBLE AS den
      FROM events WHERE event_type IN ('click', 'view')), {short_weights_sql('flags', 'condition')},
    reps AS (SELECT b, sum(w * num) FILTER (condition = 'view') / sum(w) FILTER (condition = 'view')
                      - sum(w * num) FILTER (condition = 'click') / sum(w) FILTER (condition = 'click') AS d FROM weighted GROUP BY b),
    ci AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM reps)
    SELECT CASE WHEN lo > 0 OR hi < 0 THEN 'A ABLACAO MOVE O CONTROLE — desenho comprometido, a previsao do §4 errou'
      ELSE 'nao detectado deslocamento maior que MDE=0.3 (NAO e ''sem efeito'' — ver §6-bis)' END AS verdict FROM ci""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("event_id").alias("key"), (F.col("value") > 50).alias("flag"))
    m = R.bootstrap_prop_diff(e, "condition", "click", "view", "flag", b=B, seed=SEED, make=R.short_replicates).withColumn("without_context", F.lit(0))
    return studies.ablation_slice_verdict(m).select("verdict")
