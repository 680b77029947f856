"""Gates, folds, refits and views on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import experiment as X
from marketspark.operators import regime as G
from marketspark.operators.refits import linear_fits, predicted


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    rows = [(d, f"i{k}", float(100 + r.normal()), 10.0, float(r.normal()), float(r.normal())) for d in days for k in range(8)]
    return spark.createDataFrame(rows, "date date, instrument string, close double, volume double, a double, b double")


def test_folds_are_even_and_end_before_the_last_session(panel):
    f = X.calendar_folds(panel).toPandas().sort_values("ordinal")
    assert (f.part == "train").sum() == 60 and (f.part == "valid").sum() == 20 and (f.part == "test").sum() == 20
    sizes = f.groupby("fold").size().tolist()
    assert sizes == [len(x) for x in np.array_split(np.arange(19), 3)]
    plan = X.fold_plan(X.calendar_folds(panel), 5).toPandas().sort_values("fold")
    assert (plan.train_last + 5 + 5 < plan.test_first).all()


def test_refits_equal_least_squares(spark, panel):
    rows = panel.withColumn("label", 2 * F.col("a") - F.col("b")).join(X.calendar_folds(panel).select("date", "ordinal"), "date")
    plan = X.fold_plan(X.calendar_folds(panel), 5)
    got = X.refitted(rows, ["a", "b"], plan).toPandas()
    data = rows.toPandas()
    data["y"] = data.groupby("date").label.rank(pct=True) - 0.5
    for p in plan.collect():
        fit = data[data.ordinal <= p.train_last]
        w, *_ = np.linalg.lstsq(np.c_[fit.a, fit.b, np.ones(len(fit))], fit.y, rcond=None)
        test = data[data.ordinal.between(p.test_first, p.test_last)].merge(got[got.fold == p.fold], on=["date", "instrument"])
        assert len(test) and np.allclose(np.c_[test.a, test.b, np.ones(len(test))] @ w, test.prediction, atol=1e-6)


def test_many_folds_come_from_one_pass(spark, panel):
    """Folds that share an end, that end before anything, and missing cells; dependent features."""
    rows = panel.join(X.calendar_folds(panel).select("date", "ordinal"), "date").withColumns({"y": F.col("a") * 3 + 1, "a": F.when(F.col("ordinal") % 7 != 3, F.col("a")), "c": F.col("b") * 2})
    ends = [-4, 20, 62, 62, 70, 71, 90, 500]
    plan = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "fold int, train_last int")
    fits = {f.fold: f for f in linear_fits(rows, ["a", "b", "c"], "y", plan, least_rows=100, least_dates=50).collect()}
    assert sorted(fits) == [2, 3, 4, 5, 6, 7]  # too few dates before
    data = rows.dropna().toPandas()
    for k, f in fits.items():
        own = data[data.ordinal <= ends[k]]
        assert (f.rows, f.dates) == (len(own), own.date.nunique())
        z = own[["a", "b", "c"]].to_numpy()
        assert np.allclose(z @ np.array(f.weights) + f.intercept, own.y, atol=1e-8) and abs(f.weights[2] - 2 * f.weights[1]) < 1e-8
    assert linear_fits(rows, ["a"], "y", plan, least_rows=10**6).count() == 0
    joined = rows.withColumn("fold", F.lit(4))
    assert predicted(joined, ["a", "b", "c"], linear_fits(rows, ["a", "b", "c"], "y", plan, 100, 50)).where("abs(prediction - y) > 1e-8").count() == 0


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_folds_without_enough_training_have_no_rows(spark, panel, kind):
    rows = panel.where("date < '2024-01-20'").withColumn("label", F.col("a")).join(X.calendar_folds(panel).select("date", "ordinal"), "date")
    plan = spark.createDataFrame([(1, 10, 18, 3), (2, 12, 18, -5)], "fold int, test_first int, test_last int, train_last int")
    got = X.refitted(rows, ["a", "b"], plan, kind)
    assert got.count() == 0 and got.columns == ["fold", "date", "instrument", "prediction", "label"]
    assert X.refitted(rows, ["a", "b"], plan.limit(0), kind).count() == 0


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_every_gate_speaks(spark):
    good = {"sessions": 126, "net_return": 0.1, "benchmark_return": 0.05, "max_drawdown": -0.2, "sharpe": 0.5, "good_folds": 2, "rank_ic": 0.01, "stale_sessions": 0, "stressed_return": 0.01}
    bad = {"sessions": 125, "net_return": -0.1, "benchmark_return": 0.2, "max_drawdown": -0.21, "sharpe": None, "good_folds": 1, "rank_ic": 0.0, "stale_sessions": 1, "stressed_return": 0.0}
    names = {"sessions": "sessions", "net_return": "return,benchmark", "benchmark_return": "benchmark", "max_drawdown": "drawdown", "sharpe": "sharpe", "good_folds": "folds", "rank_ic": "rank_ic", "stale_sessions": "stale", "stressed_return": "stress"}
    reasons = lambda values: _one(spark, X.gate_reasons({k: F.lit(v).cast("double") for k, v in values.items()}))
    assert reasons(good) == ""
    for k, want in names.items():
        assert reasons(good | {k: bad[k]}) == want


@pytest.mark.parametrize(
    ("own", "hold", "bears", "want"),
    [((1.0, -0.1), (0.5, -0.2), 2, ""), ((0.4, -0.1), (0.5, -0.2), 2, ""), ((0.4, -0.2), (0.5, -0.1), 2, "lags holding"), ((0.4, 0.0), (0.5, 0.0), 2, "lags holding"), ((0.4, 0.0), (0.5, -0.1), 1, "bear folds"), ((-0.1, -0.3), (-0.2, -0.1), 0, "sharpe,drawdown,bear folds")],
)
def test_promotion(spark, own, hold, bears, want):
    s, d, hs, hd = (F.lit(float(x)) for x in (*own, *hold))
    report = X.report_reasons(s, d, F.lit(9.0), hd)
    assert _one(spark, X.promote_reasons(report, s, d, hs, hd, F.lit(bears))) == want


def test_momentum_needs_volume(spark):
    rows = [(dt.date(2024, 1, i + 1), "a", float(100 + i), 0.0 if i == 5 else 1.0) for i in range(8)]
    got = [x.score for x in X.momentum_scores(spark.createDataFrame(rows, "date date, instrument string, close double, volume double"), 2).orderBy("date").collect()]
    assert got[:3] == [None] * 3 and abs(got[3] - 0.02) < 1e-12 and got[6] is None and got[7] is not None


def test_lots_go_to_the_fallback(spark):
    rows = [(1, "a", 0.5, 10.0, 1), (1, "b", 0.3, 1000.0, 1), (1, "f", 0.2, 10.0, 10), (2, "b", 0.05, 1000.0, 1), (2, "f", 0.0, 100.0, 1), (3, "a", 0.1, None, 1), (3, "f", 0.0, 10.0, 1)]
    table = spark.createDataFrame(rows, "day int, instrument string, weight double, price double, lot int")
    got = {(x.day, x.instrument): round(x.weight, 6) for x in G.feasible_weights(table, 500.0, "f", ["day"]).collect()}
    assert got == {(1, "a"): 0.5, (1, "f"): 0.5, (3, "f"): 0.1}


def test_views_are_computed_before_the_window(spark):
    rows = [("s", dt.date(2020 + i // 12, i % 12 + 1, 28), float(i * i)) for i in range(48)]
    series = spark.createDataFrame(rows, "series_id string, period_end date, value double")
    today = F.lit(dt.date(2023, 12, 28))
    change = G.series_view(series, "change", today, 2).orderBy("period_end").collect()
    assert change[0].value == 24 * 24 - 23 * 23 or change[0].value == 23 * 23 - 22 * 22
    assert not change[0].coverage_short and G.series_view(series, "level", today, 9).first().coverage_short
    assert G.series_view(series, "volatility", today, None).where("value is null").count() == 11
    with pytest.raises(KeyError):
        G.series_view(series, "other", today)


def test_scores_missing_stay_missing(spark):
    assert _one(spark, G.clipped(F.lit(None).cast("double"))) is None and _one(spark, G.clipped(F.lit(9.0))) == 2.0


def test_experiment_from_scores_to_verdict(spark):
    """A score that knows the next return and its negation; a name without closes for a while."""
    r = np.random.default_rng(11)
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(150)]
    moves = r.normal(0, 0.02, (150, 8))
    close = 100 * np.cumprod(1 + moves, axis=0)
    close[135:140, 3] = np.nan
    # known a session before it is used: the score of a day is the return from the next session to the one after
    seen = np.vstack([moves[2:], np.zeros((2, 8))])
    rows = [(d, f"i{k}", None if np.isnan(close[t, k]) else float(close[t, k]), 1.0, float(seen[t, k]), float(-seen[t, k])) for t, d in enumerate(days) for k in range(8)]
    panel = spark.createDataFrame(rows, "date date, instrument string, close double, volume double, good double, bad double")
    got = {x.strategy: x for x in X.experiment(panel, ["good", "bad"], [(2, 1), (4, 1), (4, 5)]).collect()}
    good, bad = got["good"], got["bad"]
    assert (good.k, good.every) == (2, 1) and good.sessions == 29 == bad.sessions  # one fifth, but for the last
    assert good.net_return > good.stressed_return > 0 > bad.net_return and good.good_folds == 3 and bad.good_folds == 0
    assert good.benchmark_return == bad.benchmark_return and good.rank_ic > 0.2 > -0.2 > bad.rank_ic
    assert good.reasons in ("sessions", "sessions,stale") and (good.reasons == "sessions,stale") == (good.stale_sessions > 0)
    assert {"sessions", "return", "benchmark", "folds", "rank_ic", "stress"} <= set(bad.reasons.split(","))
