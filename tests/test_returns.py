"""Panels, features, backtests: hand cases, numpy brute force, and no look-ahead."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans import backtest as bt
from riskloom.plans import panel as pn

DAY = dt.date(2020, 1, 6)


def week(i):
    return DAY + dt.timedelta(days=7 * i)


def returns_frame(spark, series):
    rows = [(s, week(i), float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(4)


def predictions_frame(spark, preds, actuals, model="m", target="t"):
    rows = [
        (model, target, week(i), float(p), float(a))
        for i, (p, a) in enumerate(zip(preds, actuals, strict=True))
    ]
    schema = "model string, target string, date date, pred double, actual double"
    return spark.createDataFrame(rows, schema).repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


# -- panel -----------------------------------------------------------------------------------


def test_calendar_and_returns(spark):
    rows = [
        (week(0), "a", 10.0),
        (week(1), "a", 20.0),
        (week(3), "a", 5.0),
        (week(4), "a", 10.0),
        (week(0), "b", 1.0),
        (week(1), "b", 0.0),
        (week(2), "b", 4.0),
    ]
    prices = spark.createDataFrame(rows, "date date, symbol string, price double")
    calendar = pn.calendar_of(prices)
    assert calendar.length == 5
    assert [r.date for r in calendar.table(spark).collect()] == [week(i) for i in range(5)]
    dense = pn.densify(prices, calendar)
    assert dense.count() == 10
    for hot in (1, 1000):
        out = pn.log_returns(dense, hot_rows=hot)
        a = column(out.where("symbol = 'a'"), "ret")
        assert a == pytest.approx([0, math.log(2), 0, 0, math.log(2)])
        assert column(out.where("symbol = 'b'"), "ret") == [0, 0, 0, 0, 0]
    raw = pn.log_returns(dense, fill=None)
    assert column(raw.where("symbol = 'b'"), "ret") == [None] * 5


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_prices_off_the_grid(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        day = lambda d: dt.date(2024, 1, d)
        rows = [(day(3), 1.0), (day(10), 2.0), (day(16), 4.0), (day(16), 3.0), (day(24), 8.0)]
        prices = spark.createDataFrame([(d, "a", p) for d, p in rows], "date date, symbol string, price double")
        calendar = pn.calendar_of(prices)
        dense = pn.densify(prices, calendar).orderBy("date").collect()
        # the 16th falls in the week of the 10th and is its last price; the larger of two counts
        assert [(r.date, r.price) for r in dense] == [
            (day(3), 1.0), (day(10), 4.0), (day(17), None), (day(24), 8.0)
        ]
        assert calendar.length == 4
        sundays = pn.calendar_of(prices, anchor="2024-02-04")
        assert (sundays.start, sundays.length) == ("2023-12-31", 4)
        hour = lambda h, m=0: dt.datetime(2021, 3, 14, h, m)
        rows = [(hour(1), "a", 1.0), (hour(2, 30), "a", 2.0), (hour(3), "a", 3.0)]
        prices = spark.createDataFrame(rows, "date timestamp_ntz, symbol string, price double")
        dense = pn.densify(prices, pn.calendar_of(prices, step="1 hour")).orderBy("date").collect()
        assert [(r.date, r.price) for r in dense] == [(hour(1), 1.0), (hour(2), 2.0), (hour(3), 3.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hourly_calendar(spark):
    rows = [(dt.datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 5)]
    prices = spark.createDataFrame(rows, "date timestamp_ntz, symbol string, price double")
    calendar = pn.calendar_of(prices, step="1 hour")
    dense = pn.densify(prices, calendar)
    assert calendar.length == 6 and dense.where("price is null").count() == 4


@pytest.mark.parametrize("hot_rows", [8, 1000])
def test_own_features_match_numpy(spark, hot_rows):
    rng = np.random.default_rng(1)
    r = rng.normal(size=30)
    df = pn.own_features(returns_frame(spark, {"a": r, "b": r[::-1]}), hot_rows=hot_rows)
    a = df.where("symbol = 'a'").orderBy("date").toPandas()
    assert a.ma4[:3].isna().all() and a.ma13[:12].isna().all() and a.momentum_12[:11].isna().all()
    assert a.ma4[20] == pytest.approx(r[17:21].mean())
    assert a.ma13[20] == pytest.approx(r[8:21].mean())
    assert a.vol4[20] == pytest.approx(r[17:21].std(ddof=1))
    assert a.momentum_12[20] == pytest.approx(r[9:21].sum())
    assert list(a.label[:-1]) == pytest.approx(list(r[1:])) and math.isnan(a.label[29])
    same = pn.own_features(returns_frame(spark, {"a": r}), horizon=0)
    assert column(same, "label") == pytest.approx(list(r))


def test_lags_do_not_wrap(spark):
    out = pn.lagged(returns_frame(spark, {"a": [1, 2, 3, 4]}), [1, 3])
    assert column(out, "lag_1") == [None, 1, 2, 3]
    assert column(out, "lag_3") == [None, None, None, 1]


def test_features_table(spark):
    rng = np.random.default_rng(2)
    series = {s: rng.normal(size=40) for s in "txyz"}
    returns = returns_frame(spark, series)
    rows = pn.make_features(returns, ["t"], ["x", "y", "z"], lags={"x": 1, "y": 2, "z": 4})
    names = pn.feature_names(["x", "y", "z"], {"x": 1, "y": 2, "z": 4})
    assert names[:3] == ["x_ret", "y_ret", "z_ret"] and len(names) == 9
    assert rows.columns == ["target", "date", "label", *names]
    got = rows.orderBy("date").toPandas()
    assert len(got) == 40 - 12 - 1  # warm-up of 13 rows, no label on the last
    i = 20
    row = got[got.date == week(i)].iloc[0]
    assert row.y_ret == pytest.approx(series["y"][i - 2])
    others = [series[s][i] for s in "xyz"]
    assert row.cross_mean == pytest.approx(np.mean(others))
    assert row.cross_dispersion == pytest.approx(np.std(others, ddof=1))
    assert row.label == pytest.approx(series["t"][i + 1])
    assert pn.feature_names(["x"], [0, 2])[:2] == ["x_ret", "x_ret_lag2"]


def test_features_and_positions_do_not_look_ahead(spark):
    rng = np.random.default_rng(4)
    series = {s: rng.normal(size=40) for s in "txy"}
    changed = {s: np.concatenate([v[:25], rng.normal(size=15)]) for s, v in series.items()}
    tables = []
    for data in (series, changed):
        rows = pn.make_features(returns_frame(spark, data), ["t"], ["x", "y"])
        features = rows.drop("label").where(F.col("date") <= F.lit(week(24)))
        tables.append(features.orderBy("date").collect())
    assert tables[0] == tables[1] and len(tables[0]) == 25 - 12
    done = []
    for preds in (series["x"], changed["x"]):
        p = predictions_frame(spark, preds, series["t"])
        cut = bt.positions(p, sizing="expanding").rows().where(F.col("date") <= F.lit(week(24)))
        done.append(column(cut, "pos"))
    assert done[0] == done[1]


def test_split_and_scaling(spark):
    rows = [("t", week(i), float(i), 5.0) for i in range(10)]
    rows += [("u", week(i), float(-i), 5.0) for i in range(5)]
    df = spark.createDataFrame(rows, "target string, date date, f double, c double")
    for hot in (2, 100):
        split = pn.chrono_split(df, hot_rows=hot)
        train = split.where("is_train").groupBy("target").count().collect()
        assert {r.target: r["count"] for r in train} == {"t": 7, "u": 3}
        assert split.where("is_train and target = 't'").agg(F.max("date")).first()[0] == week(6)
    scaled = pn.standardise(split, ["f", "c"]).where("target = 't'")
    x = np.arange(10.0)
    want = (x - x[:7].mean()) / x[:7].std()
    assert column(scaled, "f") == pytest.approx(list(want))
    assert column(scaled, "c") == [0.0] * 10


# -- backtest --------------------------------------------------------------------------------


def brute(pred, actual, cost=0.0005):
    """Week by week: the position held, what it earns less the cost of changing it, the fall from the peak."""
    largest, held = max(abs(p) for p in pred), None
    money, peak, weeks = 1.0, 0.0, []
    for forecast, outcome in zip(pred, actual):
        position = forecast / (largest + 1e-9)
        traded = 0.0 if held is None else abs(position - held)
        gain = position * outcome - cost * traded
        money *= 1 + gain
        peak = max(peak, money)
        weeks.append((position, gain, money, money / peak - 1))
        held = position
    return tuple(np.array(x) for x in zip(*weeks))


def test_small_case_by_hand(spark):
    p = predictions_frame(spark, [0.5, -1.0, 0.2], [0.01, -0.02, 0.03])
    out = bt.backtest(p).orderBy("date").collect()
    assert [r.pos for r in out] == pytest.approx([0.5, -1.0, 0.2])
    assert [r.turnover for r in out] == pytest.approx([0.0, 1.5, 1.2])
    assert [r.strat for r in out] == pytest.approx([0.005, 0.02 - 0.00075, 0.006 - 0.0006])
    assert out[-1].bnh == pytest.approx(1.01 * 0.98 * 1.03 - 1)
    assert out[-1].cum == pytest.approx(1.005 * 1.01925 * 1.0054 - 1)
    assert all(r.drawdown == 0 for r in out)


@pytest.mark.parametrize("hot_rows", [9, 1000])
def test_backtest_matches_numpy(spark, hot_rows):
    rng = np.random.default_rng(7)
    preds, actuals = rng.normal(size=70), rng.normal(scale=0.02, size=70)
    one = predictions_frame(spark, preds, actuals)
    two = predictions_frame(spark, -preds, actuals, model="n")
    curves = bt.backtest(one.unionByName(two), hot_rows=hot_rows)
    for model, sign in (("m", 1), ("n", -1)):
        pos, strat, wealth, draw = brute(sign * preds, actuals)
        mine = curves.where(F.col("model") == model)
        np.testing.assert_allclose(column(mine, "pos"), pos, atol=1e-12)
        np.testing.assert_allclose(column(mine, "strat"), strat, atol=1e-12)
        np.testing.assert_allclose(column(mine, "wealth"), wealth, rtol=1e-12)
        np.testing.assert_allclose(column(mine, "drawdown"), draw, atol=1e-12)
        summary = bt.backtest_summary(mine).first()
        assert summary.CumReturn == pytest.approx(wealth[-1] - 1)
        assert summary.Sharpe == pytest.approx(
            strat.mean() / (strat.std() + 1e-9) * math.sqrt(52), rel=1e-9
        )
        assert summary.MaxDrawdown == pytest.approx(draw.min())
        assert summary.BnH == pytest.approx(np.prod(1 + actuals) - 1)


def test_no_signal(spark):
    p = predictions_frame(spark, [0.0] * 4, [0.1, -0.1, 0.1, 0.2])
    out = bt.backtest(p)
    assert column(out, "pos") == [0.0] * 4
    assert bt.backtest_summary(out).first().Sharpe == 0.0


def test_first_loss_is_no_drawdown(spark):
    p = predictions_frame(spark, [1.0, 1.0], [-0.5, 0.1])
    assert column(bt.backtest(p), "drawdown") == [0.0, 0.0]


@pytest.mark.parametrize("rows,full", [(51, 0), (52, 1), (53, 2)])
@pytest.mark.parametrize("hot_rows", [20, 1000])
def test_rolling_sharpe_frames(spark, rows, full, hot_rows):
    rng = np.random.default_rng(rows)
    preds, actuals = rng.normal(size=rows), rng.normal(scale=0.02, size=rows)
    out = bt.rolling_sharpe_table(
        bt.backtest(predictions_frame(spark, preds, actuals), hot_rows=hot_rows)
    )
    got = column(out, "rolling_sharpe")
    assert len(got) == full
    if full:
        strat = brute(preds, actuals)[1]
        x = strat[-52:]
        assert got[-1] == pytest.approx(x.mean() / (x.std(ddof=1) + 1e-9) * math.sqrt(52))


def test_rescale(spark):
    p = predictions_frame(spark, [0.5, 1.0, 0.2], [0.01, 0.02, 0.03])
    base = np.array(column(bt.backtest(p), "strat"))
    raw = np.prod(1 + base) - 1
    scaled = column(bt.backtest(p, rescale_to=0.2), "strat")
    np.testing.assert_allclose(scaled, base * 0.2 / raw, rtol=1e-12)
    np.testing.assert_allclose(column(bt.backtest(p, rescale_to={"m": 0.2}), "strat"), scaled)
    for off in (0, None, {"m": 0.0}, {"other": 0.3}):
        np.testing.assert_allclose(column(bt.backtest(p, rescale_to=off), "strat"), base)


def test_unknown_sizing(spark):
    with pytest.raises(ValueError):
        bt.positions(predictions_frame(spark, [1.0], [1.0]), sizing="none")


# -- metrics and tables ----------------------------------------------------------------------


def test_forecast_metrics(spark):
    y, p = np.array([0.0, 1.0, -2.0, 3.0]), np.array([0.0, 0.5, 1.0, 2.0])
    got = bt.forecast_metrics(predictions_frame(spark, p, y)).first()
    assert got.RMSE == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got.MAE == pytest.approx(np.abs(y - p).mean())
    assert got.R2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.DirAcc == 0.75  # 0 agrees with 0


@pytest.mark.parametrize("preds,r2", [([1.0, 2.0], 0.0), ([1.0, 1.0], 1.0)])
def test_r2_of_constant_actual(spark, preds, r2):
    assert bt.forecast_metrics(predictions_frame(spark, preds, [1.0, 1.0])).first().R2 == r2


def test_comparison_marks_best_and_first_wins_ties(spark):
    rows = [("A", "t", 0.5, 0.1, 0.002, 1.0), ("B", "t", 0.5, 0.2, 0.001, 0.5)]
    summary = spark.createDataFrame(
        rows, "Model string, target string, DirAcc double, R2 double, MAE double, Sharpe double"
    )
    for order, winner in ((["A", "B"], "A"), (["B", "A"], "B")):
        out = bt.metric_comparison(summary, order).where("is_best").collect()
        best = {r.metric: r.Model for r in out}
        assert best == {"DirAcc": winner, "R2": "B", "MAE x 1000": "B", "Sharpe": "A"}
    assert out[0].value is not None


def test_report_tables(spark):
    p = predictions_frame(spark, [0.5, -1.0, 0.2], [0.01, -0.02, 0.03])
    curves = bt.backtest(p)
    assert column(bt.curve_table(curves), "above") == [False, True, True]
    assert bt.axis_limits(p).first().lim == pytest.approx(1.1)
    assert column(bt.scatter_table(p), "y") == [0.01, -0.02, 0.03]
    assert min(column(bt.drawdown_table(curves), "drawdown_pct")) <= 0
    row = bt.model_summary(p, curves).first()
    assert row.Model == "m" and row.DirAcc == 1.0
