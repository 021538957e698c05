"""Cost limits replayed over recorded costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_prior_sums

# Fixed value: cost assumed per sample before any was seen.
INITIAL_SAMPLE_COST = 0.008


def cost_ceiling(samples: DataFrame, ceiling: float, n_max: int, run: str = "run_id", order: str = "i") -> DataFrame:
    """Samples taken before a run's cost passed the ceiling, at most ``n_max``.

    ``order`` counts the samples of a run from zero. A sample runs while the cost of those before
    it does not exceed the ceiling.
    """
    asked = samples.filter(F.col(order) < n_max).withColumn("_c", F.coalesce("cost_usd", F.lit(0.0)))
    return with_prior_sums(asked, order, ["_c"], [run], levels=1).filter(F.col("prior__c") <= ceiling).drop("_c", "prior__c")


def ceiling_report(samples: DataFrame, ceiling: float, n_max: int, run: str = "run_id", order: str = "i") -> DataFrame:
    """Per run: samples taken, their cost and why it stopped."""
    asked = samples.filter(F.col(order) < n_max).withColumn("_c", F.coalesce("cost_usd", F.lit(0.0)))
    ran = F.col("prior__c") <= ceiling
    return with_prior_sums(asked, order, ["_c"], [run], levels=1).groupBy(run).agg(
        F.count_if(ran).alias("n_run"), F.coalesce(F.sum(F.when(ran, F.col("_c"))), F.lit(0.0)).alias("cost_usd"),
        F.when(F.count_if(~ran) > 0, "cost_ceiling").otherwise("completo").alias("stopped_reason"),
    )


def budget_brake(
    conditions: DataFrame, budget: float, n: int, plan: str = "plan_id", order: str = "ord", initial: float = INITIAL_SAMPLE_COST
) -> DataFrame:
    """Which conditions of a plan start: spent so far plus ``n`` times the mean sample cost must fit.

    ``conditions`` has ``cost_usd`` and ``n_ok`` as recorded. The first condition that does not fit
    stops the plan.
    """
    spent = with_prior_sums(conditions, order, ["cost_usd", "n_ok"], [plan], levels=1)
    mean = F.when(F.col("prior_n_ok") > 0, F.col("prior_cost_usd") / F.col("prior_n_ok")).otherwise(F.lit(initial))
    judged = spent.withColumn("estimate", n * mean).withColumn("_over", (F.col("prior_cost_usd") + F.col("estimate") > budget).cast("int"))
    braked = with_prior_sums(judged, order, ["_over"], [plan], levels=1)
    return braked.withColumn("started", (F.col("prior__over") == 0) & (F.col("_over") == 0)).drop("_over", "prior__over", "prior_n_ok").withColumnRenamed(
        "prior_cost_usd", "spent_before"
    )
