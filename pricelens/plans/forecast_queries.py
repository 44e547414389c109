"""Registered queries: accuracy metrics and the two forecast models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import forecast as FC
from ..operators import metrics as MET
from ..operators import series as ser
from .common import big, iso_date, r6
from .registry import query
from .sql_text import rnd
from .sql_views import view

PERIODS = 30


def events_series(spark, d):
    return ser.daily_series(A.price_obs(spark, d))


# ------------------------------------------------------------ metrics A6-A11

view("naive", ["series"], """
SELECT product_name, actual, predicted FROM (
  SELECT product_name, y AS actual, lag(y) OVER (PARTITION BY product_name ORDER BY ds) AS predicted
  FROM series) WHERE predicted IS NOT NULL""")

SQL_METRIC = {
    "mae": "avg(abs(actual - predicted))",
    "rmse": "sqrt(avg((actual - predicted) * (actual - predicted)))",
    "mape": "coalesce(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 0.0)",
    "smape": ("coalesce(avg(CASE WHEN (abs(actual) + abs(predicted)) / 2 <> 0 THEN abs(actual - predicted) "
              "/ ((abs(actual) + abs(predicted)) / 2) END) * 100, 0.0)"),
    "r2": ("CASE WHEN var_pop(actual) * count(actual) <> 0 THEN 1 - sum((actual - predicted) * (actual - predicted)) "
           "/ (var_pop(actual) * count(actual)) ELSE 0.0 END"),
}
IDS = {"mae": "A6", "rmse": "A7", "mape": "A8", "smape": "A9", "r2": "A10 A11"}


def _metric_query(m: str):
    def build(spark, d):
        mets = MET.forecast_metrics(FC.naive_pairs(events_series(spark, d)), ["product_name"], rounded=False)
        return mets.select("product_name", r6(m).alias(m))
    build.__name__ = f"q_metric_{m}"
    query(f"metric_{m}", IDS[m], ["naive"],
          f"SELECT product_name, {rnd(SQL_METRIC[m], 6)} AS {m} FROM naive GROUP BY product_name")(build)


for _m in ["mae", "rmse", "mape", "smape", "r2"]:
    _metric_query(_m)


@query("metrics_requested", "A11 A12", ["price_obs", "naive"], f"""
SELECT q.product_name, {', '.join(f"coalesce({m}, 0.0) AS {m}" for m in SQL_METRIC)}, coalesce(n_scored, 0) AS n_scored
FROM (SELECT product_name FROM price_obs UNION SELECT p_name FROM part) q
LEFT JOIN (SELECT product_name, count(*) AS n_scored, {', '.join(f"{rnd(x, 6)} AS {m}" for m, x in SQL_METRIC.items())}
           FROM naive GROUP BY product_name) n ON n.product_name = q.product_name""")
def q_metrics_requested(spark, d):
    """Metrics of every product asked for; all zero where no day was scored."""
    asked = A.price_obs(spark, d).select("product_name").unionByName(A.table(spark, d, "part").select(F.col("p_name").alias("product_name")))
    mets = MET.forecast_metrics(FC.naive_pairs(events_series(spark, d)), ["product_name"], rounded=False)
    full = MET.empty_metrics_for(asked, mets, ["product_name"])
    return full.select("product_name", *[r6(m).alias(m) for m in SQL_METRIC], big("n_scored").alias("n_scored"))


# ------------------------------------------------------------ shared SQL

view("fpos", ["split"], """
SELECT product_name, ds, y, idx, n, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS split
FROM split WHERE n >= 10""")

view("frows", ["fpos"], """
SELECT product_name, 'full' AS fold, ds, y, idx, n, split FROM fpos
UNION ALL
SELECT product_name, 'train' AS fold, ds, y, idx, n, split FROM fpos WHERE idx < split""")

view("m1_lin", ["frows"], f"""
SELECT *, CASE WHEN b IS NULL THEN 'degenerate'
               WHEN least(a, a + b * (n_fit - 1)) <= 0
               THEN 'additive' ELSE 'multiplicative' END AS mode
FROM (SELECT product_name, fold, regr_intercept(y, CAST(idx AS DOUBLE)) AS a,
             regr_slope(y, CAST(idx AS DOUBLE)) AS b, avg(y) AS ybar, count(*) AS n_fit, max(n) AS n
      FROM frows GROUP BY product_name, fold)""")

view("m1_g", ["frows", "m1_lin"], """
SELECT *, CASE WHEN g <> 0 THEN y / g END AS ratio, y - g AS resid FROM (
  SELECT f.product_name, f.fold, f.ds, f.y, f.idx, dayofweek(f.ds) AS dow, month(f.ds) AS mon,
         l.a, l.b, l.ybar, l.n_fit, l.mode,
         CASE WHEN l.mode = 'degenerate' THEN l.ybar ELSE l.a + l.b * f.idx END AS g
  FROM frows f JOIN m1_lin l ON f.product_name = l.product_name AND f.fold = l.fold)""")

view("m1_weekly", ["m1_g"], """
SELECT w.product_name, w.fold, w.dow, CASE WHEN l.rbar <> 0 THEN w.rw / l.rbar END AS w, w.s
FROM (SELECT product_name, fold, dow, avg(ratio) AS rw, avg(resid) AS s FROM m1_g GROUP BY ALL) w
JOIN (SELECT product_name, fold, avg(ratio) AS rbar FROM m1_g GROUP BY ALL) l
  ON w.product_name = l.product_name AND w.fold = l.fold""")

view("m1_g2", ["m1_g", "m1_weekly"], """
SELECT g.*, k.w, k.s, CASE WHEN k.w <> 0 THEN g.ratio / k.w END AS ratio2, g.resid - k.s AS resid2
FROM m1_g g LEFT JOIN m1_weekly k ON g.product_name = k.product_name AND g.fold = k.fold AND g.dow = k.dow""")

view("m1_monthly", ["m1_g2"], f"""
SELECT w.product_name, w.fold, w.mon, 1.0 + (CASE WHEN l.rbar <> 0 THEN w.rm / l.rbar END - 1.0) * w.kept AS m, w.sm * w.kept AS sm
FROM (SELECT product_name, fold, mon, avg(ratio2) AS rm, avg(resid2) AS sm,
             count(*) / (count(*) + {FC.MONTH_HALF_DAYS}.0::DOUBLE) AS kept FROM m1_g2 GROUP BY product_name, fold, mon) w
JOIN (SELECT product_name, fold, avg(ratio2) AS rbar FROM m1_g2 GROUP BY ALL) l
  ON w.product_name = l.product_name AND w.fold = l.fold""")


def _yhat_sql(t: str) -> str:
    g = f"(CASE WHEN l.mode = 'degenerate' THEN l.ybar ELSE l.a + l.b * {t} END)"
    m, sm = "coalesce(mo.m, 1.0)", "coalesce(mo.sm, 0.0)"
    return (f"(CASE WHEN l.mode = 'multiplicative' THEN {g} * coalesce(wk.w, 1.0) * {m} "
            f"ELSE {g} + coalesce(wk.s, 0.0) + {sm} END)")


def _predict_sql(points: str) -> str:
    """points(product_name, fold, t, ds, ...) -> with yhat (no band)."""
    return f"""
SELECT p.*, {_yhat_sql('p.t')} AS yhat
FROM (SELECT *, dayofweek(ds) AS dow, month(ds) AS mon FROM {points}) p
JOIN m1_lin l ON p.product_name = l.product_name AND p.fold = l.fold
LEFT JOIN m1_weekly wk ON p.product_name = wk.product_name AND p.fold = wk.fold AND p.dow = wk.dow
LEFT JOIN m1_monthly mo ON p.product_name = mo.product_name AND p.fold = mo.fold AND p.mon = mo.mon"""


view("m1_insample", ["m1_lin", "m1_weekly", "m1_monthly", "frows"],
     _predict_sql("(SELECT product_name, fold, idx AS t, ds, y FROM frows)"))

view("m1_sigma", ["m1_insample"], """
SELECT product_name, fold, stddev_samp(y - yhat) AS sigma FROM m1_insample GROUP BY product_name, fold""")

view("m1_future", ["fpos", "m1_lin", "m1_weekly", "m1_monthly", "m1_sigma"], f"""
SELECT q.product_name, q.ds, q.h, q.yhat AS predicted_price,
       q.yhat - {FC.Z80} * coalesce(s.sigma, 0.0) AS lower_bound,
       q.yhat + {FC.Z80} * coalesce(s.sigma, 0.0) AS upper_bound
FROM ({_predict_sql(f'''(SELECT product_name, 'full' AS fold, h, idx + h AS t,
                                CAST(ds + CAST(h AS INTEGER) AS DATE) AS ds
                         FROM fpos, range(1, {PERIODS + 1}) r(h) WHERE idx = n - 1)''')}) q
LEFT JOIN m1_sigma s ON q.product_name = s.product_name AND s.fold = 'full'""")

view("m1_test", ["fpos", "m1_lin", "m1_weekly", "m1_monthly"], f"""
SELECT product_name, actual, yhat AS predicted FROM ({_predict_sql(
    "(SELECT product_name, 'train' AS fold, idx AS t, ds, y AS actual FROM fpos WHERE idx >= split)")})""")

view("m1_fitted", ["fpos", "m1_lin", "m1_weekly", "m1_monthly"], f"""
SELECT product_name, ds, yhat AS fitted_price FROM ({_predict_sql(
    "(SELECT product_name, 'full' AS fold, idx AS t, ds FROM fpos)")})""")

# M2: ratio pairs by self-join, exact quantile_cont.
view("m2_ctx", ["frows"], """
SELECT * FROM frows""")

view("m2_h", ["m2_ctx"], f"""
SELECT product_name, fold, m, last_idx, base, h, least(h, m - 1) AS h_eff FROM (
  SELECT product_name, fold, m, last_idx, base,
         unnest(generate_series(1, CASE WHEN fold = 'train' THEN n - split ELSE {PERIODS} END)) AS h
  FROM (SELECT product_name, fold, count(*) AS m, max(idx) AS last_idx, arg_max(y, idx) AS base,
               max(n) AS n, max(split) AS split FROM m2_ctx GROUP BY product_name, fold))""")

view("m2_q", ["m2_h", "m2_ctx"], """
SELECT hh.product_name, hh.fold, hh.h, hh.last_idx + hh.h AS t, hh.base,
       coalesce(q.qs[1], 1.0) AS q10, coalesce(q.qs[2], 1.0) AS q50, coalesce(q.qs[3], 1.0) AS q90
FROM m2_h hh LEFT JOIN (
  SELECT x.product_name, x.fold, x.h, quantile_cont(c2.y / c1.y, [0.1, 0.5, 0.9]) AS qs
  FROM m2_h x
  JOIN m2_ctx c1 ON c1.product_name = x.product_name AND c1.fold = x.fold
  JOIN m2_ctx c2 ON c2.product_name = x.product_name AND c2.fold = x.fold AND c2.idx = c1.idx + x.h_eff
  WHERE c1.y <> 0 AND x.h_eff >= 1
  GROUP BY x.product_name, x.fold, x.h) q
ON hh.product_name = q.product_name AND hh.fold = q.fold AND hh.h = q.h""")

view("m2_future", ["m2_q", "fpos"], """
SELECT q.product_name, CAST(f.ds + CAST(q.t AS INTEGER) AS DATE) AS ds, q.h,
       q.base * q.q50 AS predicted_price, q.base * q.q10 AS lower_bound, q.base * q.q90 AS upper_bound
FROM m2_q q JOIN fpos f ON f.product_name = q.product_name AND f.idx = 0
WHERE q.fold = 'full'""")

view("m2_test", ["m2_q", "fpos"], """
SELECT q.product_name, f.y AS actual, q.base * q.q50 AS predicted
FROM m2_q q JOIN fpos f ON f.product_name = q.product_name AND f.idx = q.t
WHERE q.fold = 'train'""")

FUT_COLS = (f"product_name, strftime(ds, '%Y-%m-%d') AS ds, CAST(h AS BIGINT) AS h, "
            f"{rnd('predicted_price', 2)} AS predicted_price, {rnd('lower_bound', 2)} AS lower_bound, "
            f"{rnd('upper_bound', 2)} AS upper_bound")


def _fut_out(df):
    return df.select("product_name", iso_date("ds").alias("ds"), F.col("h").cast("long").alias("h"),
                     "predicted_price", "lower_bound", "upper_bound")


@query("forecast_trend_seasonal", "M1 W5", ["m1_future"], f"SELECT {FUT_COLS} FROM m1_future")
def q_forecast_trend_seasonal(spark, d):
    return _fut_out(FC.trend_seasonal(events_series(spark, d), PERIODS).forecast)


@query("forecast_quantile", "M2 W5", ["m2_future"], f"SELECT {FUT_COLS} FROM m2_future")
def q_forecast_quantile(spark, d):
    return _fut_out(FC.quantile(events_series(spark, d), PERIODS).forecast)


@query("fitted_values", "M3", ["m1_fitted", "fpos"], f"""
SELECT product_name, 'trend_seasonal' AS model, strftime(ds, '%Y-%m-%d') AS ds,
       {rnd('fitted_price', 2)} AS fitted_price FROM m1_fitted
UNION ALL
SELECT product_name, 'quantile', strftime(ds, '%Y-%m-%d'), {rnd('y', 2)} FROM fpos""")
def q_fitted_values(spark, d):
    s = events_series(spark, d)
    pos = FC.materialized_positions(s)
    f = FC.trend_seasonal(s, PERIODS, pos=pos).fitted.unionByName(FC.quantile(s, PERIODS, pos=pos).fitted)
    return f.select("product_name", "model", iso_date("ds").alias("ds"), "fitted_price")


def _metrics_sql(src: str) -> str:
    cols = ", ".join(f"{rnd(SQL_METRIC[m], MET.METRIC_DIGITS[m])} AS {m}" for m in MET.METRIC_NAMES)
    return f"SELECT product_name, {cols}, count(*) AS n_scored FROM {src} GROUP BY product_name"


def _metrics_out(df):
    return df.select("product_name", *MET.METRIC_NAMES, F.col("n_scored").cast("long").alias("n_scored"))


@query("forecast_metrics_trend", "M4 A6 A7 A8 A9 A10 A11 J4 W2", ["m1_test"], _metrics_sql("m1_test"))
def q_forecast_metrics_trend(spark, d):
    return _metrics_out(FC.trend_seasonal(events_series(spark, d), PERIODS).metrics)


@query("forecast_metrics_quantile", "M4 A6 A7 A8 A9 A10 A11 J4 W2", ["m2_test"], _metrics_sql("m2_test"))
def q_forecast_metrics_quantile(spark, d):
    return _metrics_out(FC.quantile(events_series(spark, d), PERIODS).metrics)


view("m_all", ["m1_test", "m2_test"], f"""
SELECT 'trend_seasonal' AS model, * FROM ({_metrics_sql('m1_test')})
UNION ALL SELECT 'quantile' AS model, * FROM ({_metrics_sql('m2_test')})""")


@query("model_winner", "J5 M6", ["m_all"], """
SELECT a.product_name, mt.metric,
       CASE mt.metric WHEN 'mape' THEN a.mape WHEN 'mae' THEN a.mae WHEN 'rmse' THEN a.rmse
                      WHEN 'r2' THEN a.r2 ELSE a.smape END AS first_value,
       CASE mt.metric WHEN 'mape' THEN b.mape WHEN 'mae' THEN b.mae WHEN 'rmse' THEN b.rmse
                      WHEN 'r2' THEN b.r2 ELSE b.smape END AS second_value,
       CASE WHEN (mt.metric = 'r2' AND b.r2 > a.r2) OR (mt.metric = 'mape' AND b.mape < a.mape)
              OR (mt.metric = 'mae' AND b.mae < a.mae) OR (mt.metric = 'rmse' AND b.rmse < a.rmse)
              OR (mt.metric = 'smape' AND b.smape < a.smape)
            THEN 'quantile' ELSE 'trend_seasonal' END AS winner
FROM (SELECT * FROM m_all WHERE model = 'trend_seasonal') a
JOIN (SELECT * FROM m_all WHERE model = 'quantile') b ON a.product_name = b.product_name,
     (VALUES ('mape'), ('mae'), ('rmse'), ('r2'), ('smape')) mt(metric)""")
def q_model_winner(spark, d):
    s = events_series(spark, d)
    pos = FC.materialized_positions(s)
    mets = FC.trend_seasonal(s, PERIODS, pos=pos).metrics.unionByName(FC.quantile(s, PERIODS, pos=pos).metrics)
    return FC.model_winner(mets)


@query("best_time_to_buy", "O7 M5", ["m1_future", "m2_future"], f"""
SELECT product_name, model, strftime(arg_min(ds, (p2, ds)), '%Y-%m-%d') AS date,
       arg_min(p2, (p2, ds)) AS predicted_price, arg_min(l2, (p2, ds)) AS lower_bound,
       arg_min(u2, (p2, ds)) AS upper_bound
FROM (SELECT product_name, 'trend_seasonal' AS model, ds, {rnd('predicted_price', 2)} AS p2,
             {rnd('lower_bound', 2)} AS l2, {rnd('upper_bound', 2)} AS u2 FROM m1_future
      UNION ALL
      SELECT product_name, 'quantile', ds, {rnd('predicted_price', 2)}, {rnd('lower_bound', 2)},
             {rnd('upper_bound', 2)} FROM m2_future)
GROUP BY product_name, model""")
def q_best_time_to_buy(spark, d):
    s = events_series(spark, d)
    pos = FC.materialized_positions(s)
    b = FC.trend_seasonal(s, PERIODS, pos=pos).best.unionByName(FC.quantile(s, PERIODS, pos=pos).best)
    return b.select("product_name", "model", iso_date("date").alias("date"), "predicted_price",
                    "lower_bound", "upper_bound")


@query("forecast_all", "U3 P10", ["m1_future", "m2_future"], f"""
SELECT product_name, 'trend_seasonal' AS model, {FUT_COLS.replace('product_name, ', '', 1)} FROM m1_future
UNION ALL
SELECT product_name, 'quantile' AS model, {FUT_COLS.replace('product_name, ', '', 1)} FROM m2_future""")
def q_forecast_all(spark, d):
    res = FC.forecast(events_series(spark, d), "both", PERIODS)
    return res.forecast.select("product_name", "model", iso_date("ds").alias("ds"), F.col("h").cast("long").alias("h"),
                               "predicted_price", "lower_bound", "upper_bound")


@query("forecast_status", "M7 P8", ["series"], """
SELECT product_name, 'quantile' AS model, CASE WHEN count(*) >= 30 THEN 'ok' ELSE 'too_few_points' END AS status
FROM series GROUP BY product_name""")
def q_forecast_status(spark, d):
    return FC.quantile(events_series(spark, d), PERIODS, min_points=30).status


@query("forecast_fourier", "M1b")
def q_forecast_fourier(spark, d):
    from ..operators import forecast_fourier as FF
    fc, _, _ = FF.fourier(events_series(spark, d), PERIODS)
    return fc.select("product_name", "model", iso_date("ds").alias("ds"), "h",
                     "predicted_price", "lower_bound", "upper_bound")
