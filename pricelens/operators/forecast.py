"""Set-based price forecasts for all products at once.

Both models keep the original contract -- fit on the first 80% of the daily
series and score the last 20% (hold-out metrics), refit on everything and
forecast ``periods`` days with an 80% band, return fitted values and the
best day to buy -- but are built from Spark aggregates, not per-product
model objects:

* ``trend_seasonal`` (M1): least-squares trend (``regr_slope`` /
  ``regr_intercept``), multiplicative weekday index of the detrended ratio,
  a month index shrunk towards 1 by the month's observed days, residual standard
  deviation for the band.  If the trend reaches zero within the horizon the
  product switches to additive indices (status ``additive``).
* ``quantile`` (M2): empirical quantiles (10/50/90%) of the h-day-ahead
  price ratio ``y[t+h] / y[t]`` over all days of the history.  A product's
  days are gathered into one array and all horizons are evaluated with array
  expressions -- no self-join producing days x horizon rows per product.

Both folds (``train`` = first 80%, ``full``) are fitted in the same
aggregations: each row is exploded into the folds it belongs to.  After the
daily series is built (one shuffle by product), the per-(product, fold)
aggregations reuse that hash partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import metrics as MET
from .series import with_position

Z80 = 1.2815515655446004   # normal quantile of 0.9: two-sided 80% band
#: Days at which a month's index counts half: a month seen on d days keeps the
#: share d / (d + MONTH_HALF_DAYS) of its distance from 1.
MONTH_HALF_DAYS = 60
KEYS = ["product_name", "fold"]
# The model selector values of the original request API
# ("prophet", "chronos", "both") map onto this library's models.
MODEL_ALIASES = {"prophet": "trend_seasonal", "chronos": "quantile",
                 "trend_seasonal": "trend_seasonal", "quantile": "quantile"}


def positioned(series: DataFrame, min_points: int = S.MIN_HISTORY_POINTS,
               train_fraction: float = S.TRAIN_FRACTION) -> DataFrame:
    """Eligible products' rows with ``idx``, ``n``, ``split`` (train size)."""
    pos = with_position(series).where(F.col("n") >= min_points)
    return pos.withColumn("split", F.floor(F.col("n") * F.lit(float(train_fraction))).cast("long"))


def fold_rows(pos: DataFrame) -> DataFrame:
    """Rows exploded into their folds: train (idx < split) and full."""
    folds = F.when(F.col("idx") < F.col("split"), F.array(F.lit("train"), F.lit("full"))) \
        .otherwise(F.array(F.lit("full")))
    return pos.withColumn("fold", F.explode(folds))


def test_points(pos: DataFrame) -> DataFrame:
    """Hold-out rows scored by the train fold (``t`` = day number)."""
    return pos.where(F.col("idx") >= F.col("split")).select(
        "product_name", F.lit("train").alias("fold"), F.col("idx").alias("t"), "ds",
        F.col("y").alias("actual"))


def future_points(pos: DataFrame, periods: int) -> DataFrame:
    """The ``periods`` days after the last day, for the full fold."""
    last = pos.where(F.col("idx") == F.col("n") - 1)
    return last.select(
        "product_name", F.lit("full").alias("fold"),
        F.posexplode(F.sequence(F.lit(1), F.lit(periods))).alias("_p", "h"), "idx", "ds",
    ).select("product_name", "fold", "h", (F.col("idx") + F.col("h")).alias("t"),
             F.date_add("ds", F.col("h").cast("int")).alias("ds"))


# ------------------------------------------------------------------ M1

@dataclass
class TrendSeasonalFit:
    """One row per (product, fold): trend ``a + b t``, mode, residual
    sigma, and the weekday / month indices as small maps (7 and 12
    entries), so predicting is a single join on (product, fold)."""
    model: DataFrame

    def predict(self, points: DataFrame) -> DataFrame:
        """Adds ``yhat``, ``lower``, ``upper`` to ``points`` (product, fold, t, ds)."""
        p = points.join(self.model, KEYS)
        wk = F.element_at("wmap", F.dayofweek("ds"))
        mo = F.element_at("mmap", F.month("ds"))
        p = p.withColumns({"w": wk["w"], "s": wk["s"], "m": mo["m"], "sm": mo["sm"]})
        band = F.lit(Z80) * F.coalesce(F.col("sigma"), F.lit(0.0))
        return p.withColumn("yhat", _yhat(F.col("t"))).withColumns(
            {"lower": F.col("yhat") - band, "upper": F.col("yhat") + band})


def _trend(t):
    return F.when(F.col("mode") == "degenerate", F.col("ybar")).otherwise(F.col("a") + F.col("b") * t)


def _yhat(t):
    m, sm = F.coalesce(F.col("m"), F.lit(1.0)), F.coalesce(F.col("sm"), F.lit(0.0))
    g = _trend(t)
    mult = g * F.coalesce(F.col("w"), F.lit(1.0)) * m
    add = g + F.coalesce(F.col("s"), F.lit(0.0)) + sm
    return F.when(F.col("mode") == "multiplicative", mult).otherwise(add)


def _index_map(detail: DataFrame, key: str, ratio_sum: str, ratio_n: str, resid: str,
               idx_name: str, add_name: str, weight=None) -> DataFrame:
    """Per (product, fold): map key -> struct(index, additive offset), where
    index = mean ratio of the key / mean ratio overall.  With ``weight`` both
    keep that share of their distance from 1 and 0."""
    level = detail.groupBy(KEYS).agg(F.try_divide(F.sum(ratio_sum), F.sum(ratio_n)).alias("_lvl"))
    index, add = F.try_divide(F.try_divide(F.col(ratio_sum), F.col(ratio_n)), F.col("_lvl")), F.col(resid)
    if weight is not None:
        index, add = F.lit(1.0) + (index - F.lit(1.0)) * weight, add * weight
    d = detail.join(level, KEYS).select(*KEYS, key, F.struct(index.alias(idx_name), add.alias(add_name)).alias("v"))
    return d.groupBy(KEYS).agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias("map"))


def fit_trend_seasonal(rows: DataFrame, periods: int, materialize: str = "checkpoint") -> TrendSeasonalFit:
    """M1 fit per (product, fold) on fold rows (product, fold, idx, ds, y, n).

    Four passes over the fold rows (trend; weekday index; month index;
    residual sigma).  The small per-(product, fold) results in between are
    materialized, so no pass recomputes an earlier one.
    """
    from ..session import materialize as mat
    r = rows.withColumns({"t": F.col("idx").cast("double"), "dow": F.dayofweek("ds"), "month": F.month("ds")})
    lin = r.groupBy(KEYS).agg(
        F.regr_intercept("y", "t").alias("a"), F.regr_slope("y", "t").alias("b"),
        F.avg("y").alias("ybar"), F.count(F.lit(1)).alias("n_fit"), F.max("n").alias("n"))
    # The form follows from the fitted history alone, so a day's price is the same at any horizon.
    t_end = F.col("n_fit") - 1
    mode = (F.when(F.col("b").isNull(), F.lit("degenerate"))
            .when(F.least(F.col("a"), F.col("a") + F.col("b") * t_end) <= 0, F.lit("additive"))
            .otherwise(F.lit("multiplicative")))
    lin = mat(lin.withColumn("mode", mode).drop("n"), materialize)

    g = r.join(lin, KEYS).withColumn("g", _trend(F.col("t")))
    g = g.withColumns({"ratio": F.try_divide(F.col("y"), F.col("g")), "resid": F.col("y") - F.col("g")})
    wk = g.groupBy(*KEYS, "dow").agg(F.sum("ratio").alias("sr"), F.count("ratio").alias("nr"),
                                     F.avg("resid").alias("s"))
    wmap = _index_map(wk, "dow", "sr", "nr", "s", "w", "s").withColumnRenamed("map", "wmap")
    model_w = mat(lin.join(wmap, KEYS, "left"), materialize)

    wv = F.element_at("wmap", F.col("dow"))
    g2 = g.join(model_w.select(*KEYS, "wmap"), KEYS).withColumns({
        "ratio2": F.try_divide(F.col("ratio"), wv["w"]), "resid2": F.col("resid") - wv["s"]})
    mo = g2.groupBy(*KEYS, "month").agg(F.sum("ratio2").alias("sr"), F.count("ratio2").alias("nr"),
                                        F.avg("resid2").alias("sm"), F.count(F.lit(1)).alias("days"))
    weight = F.col("days") / (F.col("days") + F.lit(float(MONTH_HALF_DAYS)))
    mmap = _index_map(mo, "month", "sr", "nr", "sm", "m", "sm", weight).withColumnRenamed("map", "mmap")
    model0 = model_w.join(mmap, KEYS, "left").withColumn("sigma", F.lit(None).cast("double"))
    model0 = mat(model0, materialize)

    insample = TrendSeasonalFit(model0).predict(r.select(*KEYS, "t", "ds", "y"))
    sigma = insample.groupBy(KEYS).agg(F.stddev_samp(F.col("y") - F.col("yhat")).alias("sigma"))
    model = mat(model0.drop("sigma").join(sigma, KEYS, "left"), materialize)
    return TrendSeasonalFit(model)


# ------------------------------------------------------------------ M2

def _quantile(sorted_arr, q: float):
    """Linear-interpolation quantile of a sorted array (NULL if empty)."""
    k = F.size(sorted_arr)
    pos = (k - 1).cast("double") * F.lit(q)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    vlo, vhi = F.get(sorted_arr, lo), F.get(sorted_arr, hi)
    return F.when(k > 0, F.when(lo == hi, vlo).otherwise(vlo + (vhi - vlo) * (pos - lo)))


def quantile_paths(rows: DataFrame, periods: int, context_days: int | None = None) -> DataFrame:
    """M2: per (product, fold, h) the 10/50/90% quantiles of the h-day ratio
    and the base value they scale.  Train fold horizons cover the test days
    (``n - split``), the full fold ``periods`` days.  The ratios cover the whole
    history, or its last ``context_days`` where a caller asks for that."""
    n_ctx = F.when(F.col("fold") == "train", F.col("split")).otherwise(F.col("n"))
    ctx = rows if context_days is None else rows.where(F.col("idx") >= n_ctx - context_days)
    arr = ctx.groupBy(KEYS).agg(
        F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("pts"),
        F.max("n").alias("n"), F.max("split").alias("split"), F.max("idx").alias("last_idx"))
    arr = arr.select(*KEYS, "n", "split", "last_idx",
                     F.transform("pts", lambda p: p["y"]).alias("ys"))
    horizon = F.when(F.col("fold") == "train", F.col("n") - F.col("split")).otherwise(F.lit(periods))
    ex = arr.select("*", F.explode(F.sequence(F.lit(1), horizon.cast("int"))).alias("h"))
    m = F.size("ys")
    h_eff = F.least(F.col("h"), m - 1)
    ratios = F.filter(
        F.transform(F.sequence(F.lit(0), m - 1 - h_eff),
                    lambda i: F.try_divide(F.get("ys", i + h_eff), F.get("ys", i))),
        lambda x: x.isNotNull())
    ex = ex.withColumn("rs", F.when(h_eff >= 1, F.array_sort(ratios)).otherwise(F.array().cast("array<double>")))
    base = F.get("ys", m - 1)
    return ex.select(
        *KEYS, "h", (F.col("last_idx") + F.col("h")).alias("t"), base.alias("base"),
        F.coalesce(_quantile(F.col("rs"), 0.1), F.lit(1.0)).alias("q10"),
        F.coalesce(_quantile(F.col("rs"), 0.5), F.lit(1.0)).alias("q50"),
        F.coalesce(_quantile(F.col("rs"), 0.9), F.lit(1.0)).alias("q90"))


# ----------------------------------------------------------- the job

@dataclass
class ForecastResult:
    forecast: DataFrame   # product, model, ds, h, predicted_price, lower_bound, upper_bound
    fitted: DataFrame     # product, model, ds, fitted_price
    metrics: DataFrame    # product, model, mape, mae, rmse, r2, smape
    best: DataFrame       # product, model, date, predicted_price, lower_bound, upper_bound
    status: DataFrame     # product, model, status


def _round2(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in cols})


def materialized_positions(series: DataFrame, min_points: int = S.MIN_HISTORY_POINTS,
                           materialize: str = "checkpoint") -> DataFrame:
    """The eligible daily series with positions, computed once: every model
    branch (fits, test rows, future days) reads it."""
    from ..session import materialize as mat
    return mat(positioned(series, min_points), materialize)


def rejected_status(series: DataFrame, min_points: int, model: str) -> DataFrame:
    """M7: the products that P8 rejects, with the reason."""
    days = series.groupBy("product_name").agg(F.count(F.lit(1)).alias("n"))
    return days.where(F.col("n") < min_points).select("product_name", F.lit(model).alias("model"), F.lit("too_few_points").alias("status"))


def trend_seasonal(series: DataFrame, periods: int = S.DEFAULT_PERIODS,
                   min_points: int = S.MIN_HISTORY_POINTS, pos: DataFrame | None = None,
                   materialize: str = "checkpoint", floor: float | None = None) -> ForecastResult:
    """M1/M3/M4/M5/M7 for every product.  Predictions are not clamped unless
    ``floor`` is given (the original does not clamp)."""
    pos = pos if pos is not None else materialized_positions(series, min_points, materialize)
    fit = fit_trend_seasonal(fold_rows(pos), periods, materialize)
    model = F.lit("trend_seasonal").alias("model")
    fut = fit.predict(future_points(pos, periods)).select(
        "product_name", model, "ds", "h", F.col("yhat").alias("predicted_price"),
        F.col("lower").alias("lower_bound"), F.col("upper").alias("upper_bound"))
    if floor is not None:
        fut = fut.withColumns({c: F.greatest(F.col(c), F.lit(float(floor)))
                               for c in ["predicted_price", "lower_bound", "upper_bound"]})
    fut = _round2(fut, ["predicted_price", "lower_bound", "upper_bound"])
    inpts = pos.select("product_name", F.lit("full").alias("fold"), F.col("idx").alias("t"), "ds")
    fitted = _round2(fit.predict(inpts).select("product_name", model, "ds", F.col("yhat").alias("fitted_price")),
                     ["fitted_price"])
    test = fit.predict(test_points(pos))
    mets = MET.forecast_metrics(test.withColumn("model", F.lit("trend_seasonal")), ["product_name", "model"],
                                "actual", "yhat")
    status = fit.model.where(F.col("fold") == "full").select(
        "product_name", model,
        F.when(F.col("mode") == "multiplicative", F.lit("ok")).otherwise(F.col("mode")).alias("status"))
    status = status.unionByName(rejected_status(series, min_points, "trend_seasonal"))
    return ForecastResult(fut, fitted, mets, best_time_to_buy(fut), status)


def quantile(series: DataFrame, periods: int = S.DEFAULT_PERIODS,
             min_points: int = S.MIN_HISTORY_POINTS, context_days: int | None = None,
             pos: DataFrame | None = None, materialize: str = "checkpoint") -> ForecastResult:
    """M2/M3/M4/M5 for every product."""
    from ..session import materialize as mat
    pos = pos if pos is not None else materialized_positions(series, min_points, materialize)
    # Forecast and hold-out metrics both read the quantile table.
    paths = mat(quantile_paths(fold_rows(pos), periods, context_days), materialize)
    model = F.lit("quantile").alias("model")
    first = pos.where(F.col("idx") == 0).select("product_name", F.col("ds").alias("ds0"))
    full = paths.where(F.col("fold") == "full").join(first, "product_name")
    fut = full.select(
        "product_name", model, F.date_add("ds0", F.col("t").cast("int")).alias("ds"), "h",
        (F.col("base") * F.col("q50")).alias("predicted_price"),
        (F.col("base") * F.col("q10")).alias("lower_bound"),
        (F.col("base") * F.col("q90")).alias("upper_bound"))
    fut = _round2(fut, ["predicted_price", "lower_bound", "upper_bound"])
    fitted = _round2(pos.select("product_name", model, "ds", F.col("y").alias("fitted_price")), ["fitted_price"])
    test = paths.where(F.col("fold") == "train").join(
        test_points(pos).drop("fold"), ["product_name", "t"]).select(
        "product_name", F.lit("quantile").alias("model"), "actual",
        (F.col("base") * F.col("q50")).alias("predicted"))
    mets = MET.forecast_metrics(test, ["product_name", "model"], "actual", "predicted")
    status = pos.select("product_name").distinct().select("product_name", model, F.lit("ok").alias("status"))
    status = status.unionByName(rejected_status(series, min_points, "quantile"))
    return ForecastResult(fut, fitted, mets, best_time_to_buy(fut), status)


def best_time_to_buy(fut: DataFrame) -> DataFrame:
    """The day with the lowest (rounded) predicted price, the first
    such day on ties, with its bounds."""
    pick = F.min_by(F.struct("ds", "predicted_price", "lower_bound", "upper_bound"),
                    F.struct(F.round("predicted_price", 2), "ds"))
    b = fut.groupBy("product_name", "model").agg(pick.alias("b"))
    return b.select("product_name", "model", F.col("b.ds").alias("date"), F.col("b.predicted_price").alias(
        "predicted_price"), F.col("b.lower_bound").alias("lower_bound"), F.col("b.upper_bound").alias("upper_bound"))


def forecast(series: DataFrame, model: str = "both", periods: int = S.DEFAULT_PERIODS,
             min_points: int = S.MIN_HISTORY_POINTS) -> ForecastResult | None:
    """Run the selected model(s) and union their outputs with a
    ``model`` column.  Any other selector value returns ``None`` (history
    only, as in the original)."""
    names = ["trend_seasonal", "quantile"] if model == "both" else (
        [MODEL_ALIASES[model]] if model in MODEL_ALIASES else [])
    if not names:
        return None
    pos = materialized_positions(series, min_points)
    runs = [trend_seasonal(series, periods, min_points, pos=pos) if n == "trend_seasonal"
            else quantile(series, periods, min_points, pos=pos) for n in names]
    if len(runs) == 1:
        return runs[0]
    a, b = runs

    def u(x, y):
        return x.unionByName(y)
    return ForecastResult(u(a.forecast, b.forecast), u(a.fitted, b.fitted), u(a.metrics, b.metrics),
                          u(a.best, b.best), u(a.status, b.status))


def model_winner(metrics: DataFrame, first_model: str = "trend_seasonal",
                 second_model: str = "quantile") -> DataFrame:
    """Per product and metric the better model: higher R² wins, lower
    error wins for the others; a tie goes to the first model."""
    a = metrics.where(F.col("model") == first_model)
    b = metrics.where(F.col("model") == second_model)
    j = a.alias("a").join(b.alias("b"), "product_name")
    rows = []
    for m in MET.METRIC_NAMES:
        better_b = (F.col(f"b.{m}") > F.col(f"a.{m}")) if m == "r2" else (F.col(f"b.{m}") < F.col(f"a.{m}"))
        rows.append(F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("first_value"),
                             F.col(f"b.{m}").alias("second_value"),
                             F.when(better_b, F.lit(second_model)).otherwise(F.lit(first_model)).alias("winner")))
    return j.select("product_name", F.explode(F.array(*rows)).alias("r")).select("product_name", "r.*")


def naive_pairs(series: DataFrame) -> DataFrame:
    """Scored pairs of the persistence forecast (yesterday's price), used to
    exercise the metrics on every product's whole series."""
    w = Window.partitionBy("product_name").orderBy("ds")
    return series.withColumn("predicted", F.lag("y").over(w)).where(F.col("predicted").isNotNull()) \
        .select("product_name", "ds", F.col("y").alias("actual"), "predicted")
