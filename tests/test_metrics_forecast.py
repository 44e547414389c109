import datetime as dt
import math


from conftest import rows
from pricelens.operators import forecast as FC
from pricelens.operators import metrics as MET


def pairs(spark, a, p, key="A"):
    return spark.createDataFrame([(key, float(x), float(y)) for x, y in zip(a, p)],
                                 "product_name string, actual double, predicted double")


def test_metrics_fixture(spark):
    m = MET.forecast_metrics(pairs(spark, [100, 0, 50], [110, 5, 50]), rounded=False).collect()[0]
    assert math.isclose(m.mae, 5.0)
    assert math.isclose(m.rmse, math.sqrt(125 / 3))
    assert math.isclose(m.mape, 5.0)
    assert math.isclose(m.smape, (10 / 105 + 5 / 2.5 + 0) / 3 * 100)
    assert math.isclose(m.r2, 0.975)
    r = MET.forecast_metrics(pairs(spark, [100, 0, 50], [110, 5, 50])).collect()[0]
    assert (r.mae, r.rmse, r.r2) == (5.0, 6.45, 0.975)


def test_metrics_constant_actual_and_empty(spark):
    m = MET.forecast_metrics(pairs(spark, [3, 3, 3], [1, 2, 3])).collect()[0]
    assert m.r2 == 0.0
    keys = spark.createDataFrame([("A",), ("B",)], "product_name string")
    z = {r.product_name: r for r in MET.empty_metrics_for(
        keys, MET.forecast_metrics(pairs(spark, [1], [1])), ["product_name"]).collect()}
    assert all(getattr(z["B"], k) == 0.0 for k in MET.METRIC_NAMES)


def test_metrics_bounds_property(spark):
    import random
    rnd = random.Random(3)
    a = [rnd.uniform(-50, 50) for _ in range(200)]
    p = [x + rnd.gauss(0, 5) for x in a]
    m = MET.forecast_metrics(pairs(spark, a, p), rounded=False).collect()[0]
    assert m.mae >= 0 and m.rmse >= m.mae - 1e-12 and m.mape >= 0 and m.smape >= 0 and m.r2 <= 1


def series(spark, ys, product="A", start="2024-01-01"):
    d0 = dt.date.fromisoformat(start)
    return spark.createDataFrame([(product, d0 + dt.timedelta(days=i), float(y)) for i, y in enumerate(ys)],
                                 "product_name string, ds date, y double")


def test_trend_model_continues_a_line(spark):
    res = FC.trend_seasonal(series(spark, [100 + 2 * i for i in range(40)]), periods=5)
    fut = rows(res.forecast, "h", "predicted_price", "lower_bound", "upper_bound")
    assert [r[1] for r in fut] == [180.0, 182.0, 184.0, 186.0, 188.0]
    assert all(r[2] == r[1] == r[3] for r in fut)      # zero residual: zero band
    m = res.metrics.collect()[0]
    assert m.mae == 0.0 and m.r2 == 1.0
    st = res.status.collect()[0]
    assert st.status == "ok"


def test_trend_model_additive_guard(spark):
    res = FC.trend_seasonal(series(spark, [30 - 2 * i for i in range(20)]), periods=30)
    assert res.status.collect()[0].status == "additive"


def test_quantile_model_constant_series(spark):
    res = FC.quantile(series(spark, [7.0] * 20), periods=4)
    fut = rows(res.forecast, "h", "predicted_price", "lower_bound", "upper_bound")
    assert fut == [(h, 7.0, 7.0, 7.0) for h in range(1, 5)]
    fitted = rows(res.fitted, "fitted_price")
    assert fitted == [(7.0,)] * 20


def test_quantile_model_matches_percentile(spark):
    ys = [10, 11, 9, 12, 10, 13, 11, 12, 14, 13, 12, 15]
    res = FC.quantile(series(spark, ys), periods=2)
    got = dict(rows(res.forecast, "h", "predicted_price"))
    r1 = sorted(ys[i + 1] / ys[i] for i in range(len(ys) - 1))
    import numpy as np
    assert math.isclose(got[1], round(ys[-1] * float(np.quantile(r1, 0.5)), 2))


def test_best_day_first_on_ties(spark):
    fut = spark.createDataFrame(
        [("A", "m", dt.date(2024, 1, d), p, p - 1, p + 1) for d, p in [(1, 5.0), (2, 4.001), (3, 3.999), (4, 6.0)]],
        "product_name string, model string, ds date, predicted_price double, lower_bound double, upper_bound double")
    b = FC.best_time_to_buy(fut).collect()[0]
    assert b.date == dt.date(2024, 1, 2)


def test_model_winner_ties_go_first(spark):
    m = spark.createDataFrame(
        [("A", "trend_seasonal", 1.0, 2.0, 3.0, 0.5, 1.0), ("A", "quantile", 1.0, 1.0, 4.0, 0.6, 1.0)],
        "product_name string, model string, mape double, mae double, rmse double, r2 double, smape double")
    w = dict(rows(FC.model_winner(m), "metric", "winner"))
    assert w == {"mape": "trend_seasonal", "mae": "quantile", "rmse": "trend_seasonal",
                 "r2": "quantile", "smape": "trend_seasonal"}


def test_model_selector(spark):
    s = series(spark, list(range(1, 15)))
    assert FC.forecast(s, "history_only") is None
    assert {r.model for r in FC.forecast(s, "prophet", periods=2).forecast.collect()} == {"trend_seasonal"}
    assert {r.model for r in FC.forecast(s, "both", periods=2).forecast.collect()} == {"trend_seasonal", "quantile"}


def test_month_index_grows_with_the_days_seen(spark):
    """No history length switches the month index on: a day's price hardly
    moves from 729 to 731 days, and more Januaries count for more."""
    import datetime as dt

    def price(n):
        days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
        s = series(spark, [100.0 + (20 if d.month == 1 else 0) for d in days], start="2020-01-01")
        return {r.ds: r.predicted_price for r in FC.trend_seasonal(s, periods=365).forecast.collect()}
    near, far = price(729), price(731)
    assert max(abs(near[d] - far[d]) for d in near if d in far) < 0.5
    gap = [p[dt.date(y, 1, 15)] - p[dt.date(y - 1, 12, 15)] for p, y in ((price(400), 2022), (price(1200), 2024))]
    assert 0 < gap[0] < gap[1] < 20


def test_fourier_variant_tracks_weekly_pattern(spark):
    from pricelens.operators import forecast_fourier as FF
    ys = [100 + 0.5 * i + (10 if i % 7 in (5, 6) else 0) for i in range(120)]
    fc, mets, best = FF.fourier(series(spark, ys), periods=14)
    f = rows(fc, "h", "predicted_price")
    assert len(f) == 14
    m = mets.collect()[0]
    assert m.mape < 5.0
    assert best.count() == 1


def test_fourier_equals_a_direct_solve(spark):
    """Both folds' coefficients and the forecast against one dense ridge solve of
    all daily rows, for several lengths, a constant zero series among them."""
    import numpy as np

    from pricelens.operators import forecast_fourier as FF

    def direct(y, scale):
        n = len(y)
        t, span = np.arange(n, dtype=float), max(n - 1.0, 1.0)

        def trend_basis(t):
            x = t / span
            return np.column_stack([np.ones_like(x), x] + [np.maximum(0, x - 0.8 * k / 26) for k in range(1, 26)])

        def season_basis(t):
            return np.column_stack([f(2 * np.pi * k * t / p) for p, o in ((7.0, 3), (365.25, 10)) for f in (np.sin, np.cos) for k in range(1, o + 1)])
        x = trend_basis(t)
        beta = np.linalg.lstsq(x.T @ x + np.diag([0.0, 0.0] + [20.0] * 25), x.T @ (y / scale), rcond=None)[0]
        level = x @ beta
        ratio = np.array([a / b - 1 if abs(b) > 1e-9 else 0.0 for a, b in zip(y / scale, level)])
        z = season_basis(t)
        gamma = np.linalg.lstsq(z.T @ z + 0.1 * np.eye(26), z.T @ ratio, rcond=None)[0]
        return beta, gamma, lambda t: trend_basis(t) @ beta * (1 + season_basis(t) @ gamma) * scale

    rng = np.random.default_rng(7)
    ys = {f"p{n}": 50 + np.cumsum(rng.normal(0, 1, n)) + 5 * np.sin(np.arange(n) / 9) for n in (10, 37, 400, 900)}
    ys["zero"] = np.zeros(30)
    s = None
    for name, y in ys.items():
        part = series(spark, y.tolist(), product=name)
        s = part if s is None else s.unionByName(part)
    model = {(r.product_name, r.fold): r for r in FF.fit(FF.materialized_positions(s)).collect()}
    fc, mets, _ = FF.fourier(s, periods=5)
    fc = {(r.product_name, r.h): r for r in fc.collect()}
    for name, y in ys.items():
        scale = max(abs(y)) or 1.0
        for fold, part in (("full", y), ("train", y[:int(len(y) * 0.8)])):
            beta, gamma, price = direct(part, scale)
            assert np.allclose(model[name, fold].beta, beta, atol=1e-6) and np.allclose(model[name, fold].gamma, gamma, atol=1e-6)
            if fold == "full":
                band = 1.2816 * np.std(y - price(np.arange(len(y), dtype=float)), ddof=1)
                want = price(np.arange(len(y), len(y) + 5, dtype=float))
                for h in range(5):
                    assert abs(fc[name, h + 1].predicted_price - want[h]) < 0.011
                    assert abs(fc[name, h + 1].upper_bound - want[h] - band) < 0.02
    assert mets.count() == len(ys)


def test_a_day_has_one_price_at_any_horizon(spark):
    s = series(spark, [40 - 0.6 * i + (i % 7) for i in range(40)])
    near = {r.ds: r.predicted_price for r in FC.trend_seasonal(s, periods=7).forecast.collect()}
    far = {r.ds: r.predicted_price for r in FC.trend_seasonal(s, periods=60).forecast.collect()}
    assert near == {d: far[d] for d in near}
