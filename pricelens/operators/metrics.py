"""Forecast accuracy metrics (A6-A11) as one grouped aggregation.

``pairs`` holds one row per scored day: ``actual`` and ``predicted`` plus
the grouping keys.  Every metric is an algebraic aggregate (partial +
final), so scoring any number of products costs one shuffle of partial
sums at most.  R² uses ``var_pop`` (a stable streaming second moment)
instead of the cancellation-prone ``Σa² - n·ā²``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_NAMES = ["mape", "mae", "rmse", "r2", "smape"]
# Decimal places of each metric in the reported result.
METRIC_DIGITS = {"mape": 2, "mae": 2, "rmse": 2, "r2": 4, "smape": 2}


def metric_aggs(actual: str = "actual", predicted: str = "predicted") -> list:
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    ae = F.abs(e)
    denom = (F.abs(a) + F.abs(p)) / 2
    n = F.count(a)
    ss_res = F.sum(e * e)
    ss_tot = F.var_pop(a) * n
    return [
        F.coalesce(F.avg(F.when(a != 0, ae / F.abs(a))) * 100, F.lit(0.0)).alias("mape"),
        F.coalesce(F.avg(ae), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("rmse"),
        F.when(ss_tot != 0, 1 - ss_res / ss_tot).otherwise(F.lit(0.0)).alias("r2"),
        F.coalesce(F.avg(F.when(denom != 0, ae / denom)) * 100, F.lit(0.0)).alias("smape"),
        n.alias("n_scored"),
    ]


def forecast_metrics(pairs: DataFrame, keys: Sequence[str] = ("product_name",),
                     actual: str = "actual", predicted: str = "predicted",
                     rounded: bool = True) -> DataFrame:
    """A6-A10 per key; A11 rounding (2/2/2/4/2 places) when ``rounded``."""
    out = pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()) \
        .groupBy(*keys).agg(*metric_aggs(actual, predicted))
    return round_metrics(out) if rounded else out


def round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, d) for m, d in METRIC_DIGITS.items()})


def empty_metrics_for(keys_df: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without any scored pair get all-zero metrics."""
    j = keys_df.select(*keys).distinct().join(metrics, list(keys), "left")
    return j.withColumns({m: F.coalesce(F.col(m), F.lit(0.0)) for m in METRIC_NAMES}) \
        .withColumn("n_scored", F.coalesce(F.col("n_scored"), F.lit(0)))
