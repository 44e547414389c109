"""Piecewise-linear trend with changepoints and Fourier seasonality.

Same contract as the other models (80/20 hold-out metrics, refit on all
days, ``periods``-day forecast with an 80% band, best day).  The design
matrix has an intercept, a slope, 25 hinge terms ``max(0, t - c_k)`` at
changepoints spread over the first 80% of the history, and 3 weekly and 10
yearly sine/cosine pairs; seasonality is multiplicative on the trend.
Ridge penalties stand in for the usual priors.  25, 3, 10 and 80% are the
public defaults of this model family.

The fits are normal equations.  Days are numbered without gaps, so the basis
values of a fold, and with them the left side, depend on its number of days
alone; the right sides are grouped sums of basis column times price (or times
the ratio of price to trend) over the daily rows, partial sums first.  Only the
27 or 26 numbers of a (product, fold) meet the solver, a vectorized function of
rows; daily rows are never gathered in a group.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import metrics as MET
from .forecast import KEYS, Z80, best_time_to_buy, fold_rows, future_points, materialized_positions, test_points

N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
WEEKLY_ORDER = 3
YEARLY_ORDER = 10
RIDGE_TREND = 1.0 / 0.05          # changepoint prior scale 0.05
RIDGE_SEASON = 1.0 / 10.0

#: Changepoints as shares of the history.
CHANGEPOINTS = [CHANGEPOINT_RANGE * k / (N_CHANGEPOINTS + 1) for k in range(1, N_CHANGEPOINTS + 1)]
SEASONS = [(7.0, WEEKLY_ORDER), (365.25, YEARLY_ORDER)]


def _trend_columns(t: Column, span: Column) -> list[Column]:
    x = t / span
    return [F.lit(1.0), x] + [F.greatest(F.lit(0.0), x - F.lit(c)) for c in CHANGEPOINTS]


def _season_columns(t: Column) -> list[Column]:
    out = []
    for period, order in SEASONS:
        angle = [F.lit(2 * np.pi * k / period) * t for k in range(1, order + 1)]
        out += [F.sin(x) for x in angle] + [F.cos(x) for x in angle]
    return out


@functools.lru_cache(maxsize=64)
def _trend_left(n: int) -> np.ndarray:
    """Left side of the trend's equations for ``n`` days, penalties included."""
    x = np.arange(n) / max(n - 1.0, 1.0)
    basis = np.hstack([np.ones((n, 1)), x[:, None], np.maximum(0.0, x[:, None] - np.array(CHANGEPOINTS)[None, :])])
    return basis.T @ basis + np.diag(np.r_[0.0, 0.0, np.full(N_CHANGEPOINTS, RIDGE_TREND)])


@functools.lru_cache(maxsize=64)
def _season_left(n: int) -> np.ndarray:
    t, cols = np.arange(n, dtype=float), []
    for period, order in SEASONS:
        angle = 2 * np.pi * np.outer(t, np.arange(1, order + 1)) / period
        cols += [np.sin(angle), np.cos(angle)]
    basis = np.hstack(cols)
    return basis.T @ basis + RIDGE_SEASON * np.eye(basis.shape[1])


def _solver(left):
    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(left(int(k)), np.asarray(r, float), rcond=None)[0].tolist() for k, r in zip(n, right)])
    return solve


def _dot(columns: list[Column], weights: str) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(columns):
        out = out + F.get(weights, F.lit(i)) * c
    return out


def _trend(t: Column) -> Column:
    return _dot(_trend_columns(t, F.col("span")), "beta")


def _price(t: Column) -> Column:
    return _trend(t) * (F.lit(1.0) + _dot(_season_columns(t), "gamma")) * F.col("scale")


def fit(pos: DataFrame, materialize: str = "checkpoint") -> DataFrame:
    """``beta``, ``gamma``, ``n_fit``, ``span`` and ``scale`` of every (product,
    fold) of the positioned series."""
    from ..session import materialize as mat
    t = F.col("idx").cast("double")
    rows = fold_rows(pos).withColumn("n_fit", F.when(F.col("fold") == "full", F.col("n")).otherwise(F.col("split"))).withColumn(
        "span", F.greatest(F.col("n_fit") - 1.0, F.lit(1.0)))
    # both folds are scaled by the whole history's greatest price
    scale = pos.groupBy("product_name").agg(F.max(F.abs("y")).alias("scale")).select(
        "product_name", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))
    sums = [F.sum(c * F.col("y")) for c in _trend_columns(t, F.col("span"))]
    trend = rows.groupBy(*KEYS).agg(F.max("n_fit").alias("n_fit"), F.max("span").alias("span"), F.array(*sums).alias("right")).join(scale, "product_name")
    trend = mat(trend.select(*KEYS, "n_fit", "span", "scale", _solver(_trend_left)(
        "n_fit", F.transform("right", lambda x: x / F.col("scale"))).alias("beta")), materialize)
    level = _trend(t)
    ratio = F.coalesce(F.when(F.abs(level) > 1e-9, F.col("y") / F.col("scale") / level - 1.0), F.lit(0.0))
    detail = rows.select(*KEYS, "idx", "y").join(trend, KEYS).withColumn("ratio", ratio)
    season = detail.groupBy(*KEYS).agg(F.max("n_fit").alias("n"), F.array(*[F.sum(c * F.col("ratio")) for c in _season_columns(t)]).alias("right"))
    season = season.select(*KEYS, _solver(_season_left)("n", "right").alias("gamma"))
    return mat(trend.join(season, KEYS), materialize)


def fourier(series: DataFrame, periods: int = S.DEFAULT_PERIODS,
            min_points: int = S.MIN_HISTORY_POINTS,
            materialize: str = "checkpoint") -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1b for every eligible product: (forecast, metrics, best day)."""
    from ..session import materialize as mat
    pos = materialized_positions(series, min_points, materialize)
    model, name = fit(pos, materialize), F.lit("fourier").alias("model")
    t = F.col("t").cast("double")
    full = model.where(F.col("fold") == "full")
    inside = pos.select("product_name", F.col("idx").alias("t"), "y").join(full, "product_name").withColumn("left", F.col("y") - _price(t))
    sigma = inside.groupBy("product_name").agg(F.coalesce(F.stddev_samp("left"), F.lit(0.0)).alias("sigma"))
    future = future_points(pos, periods).join(model, KEYS).join(sigma, "product_name").withColumn("yhat", _price(t))
    band = F.lit(Z80) * F.col("sigma")
    fc = mat(future.select("product_name", name, "ds", F.col("h").cast("int").alias("h"), F.round("yhat", 2).alias("predicted_price"),
                           F.round(F.col("yhat") - band, 2).alias("lower_bound"), F.round(F.col("yhat") + band, 2).alias("upper_bound")), materialize)
    held = test_points(pos).join(model, KEYS).select("product_name", name, "ds", "actual", _price(t).alias("predicted_price"))
    mets = MET.forecast_metrics(held, ["product_name", "model"], "actual", "predicted_price")
    return fc, mets, best_time_to_buy(fc)
