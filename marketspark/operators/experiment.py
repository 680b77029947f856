"""Experiments without leakage: warm-up, calendar folds and refits, choice of portfolios, benchmarks, metrics and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.desk import failed_rules
from marketspark.operators.evaluation import daily_rank_ic, rank_label
from marketspark.operators.model import fit_predict
from marketspark.operators.lineage import cut
from marketspark.operators.panel import calendar, line
from marketspark.operators.portfolio import performance, top_k_grid, top_k_stale
from marketspark.operators.refits import LEAST_DATES, LEAST_ROWS, linear_fits, predicted


def warmed(panel: DataFrame, features: list[str], sessions: int = 60) -> DataFrame:
    """Features are null before the `sessions`-th session of the calendar and where the name had no close the session before."""
    days = F.broadcast(calendar(panel))  # one row a session
    known = F.lag("close", 1).over(line()).isNotNull()
    rows = panel.join(days, "date")
    return rows.withColumns({f: F.when(known & (F.col("ordinal") >= sessions), F.col(f)) for f in features}).drop("ordinal")


def calendar_folds(panel: DataFrame, valid: float = 0.6, test: float = 0.8, folds: int = 3) -> DataFrame:
    """date, ordinal, part (train, valid, test), fold: the test sessions but the last (it has no next return) in `folds`
    consecutive parts whose sizes differ by at most one, larger ones first. Depends on the calendar alone."""
    days = calendar(panel)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # one row a session
    at_valid, at_test = F.floor(n * valid), F.floor(n * test)
    part = F.when(F.col("ordinal") >= at_test, "test").when(F.col("ordinal") >= at_valid, "valid").otherwise("train")
    tested = (F.col("ordinal") >= at_test) & (F.col("ordinal") < n - 1)
    fold = F.ntile(folds).over(Window.partitionBy(tested).orderBy("ordinal"))
    return days.select("date", "ordinal", part.alias("part"), F.when(tested, fold).alias("fold"))


def fold_plan(folds: DataFrame, horizon: int, embargo: int = 5) -> DataFrame:
    """fold, test_first, test_last, train_last: ordinals; the last training session's label is known `embargo` sessions
    before the fold begins."""
    plan = folds.where("fold is not null").groupBy("fold").agg(F.min("ordinal").alias("test_first"), F.max("ordinal").alias("test_last"))
    return plan.withColumn("train_last", F.col("test_first") - horizon - embargo - 1)


def refitted(rows: DataFrame, features: list[str], plan: DataFrame, kind: str = "linear", least_rows: int = LEAST_ROWS, least_dates: int = LEAST_DATES) -> DataFrame:
    """rows(date, ordinal, instrument, features, label): predictions for every fold of a model fitted on all sessions that its
    plan allows; date-local ranks of the label are learned, so market level cannot be.

    Linear models of all folds come from one pass (linear_fits). Trees are one fit a fold; folds are few. Folds that cannot
    be fitted have no rows."""
    ranked = rows.withColumn("raw", F.col("label")).withColumn("label", rank_label(rows, "label", ["date"]))
    names = ["fold", "date", "instrument", "prediction", F.col("raw").alias("label")]
    if kind == "linear":
        fits = linear_fits(ranked, features, "label", plan, least_rows, least_dates)
        spans = F.broadcast(plan.select("fold", F.explode(F.sequence("test_first", "test_last")).alias("ordinal")))  # one row a test session
        return predicted(ranked.join(spans, "ordinal"), features, fits).select(*names)
    out = []
    for p in plan.orderBy("fold").collect():
        part = F.when(F.col("ordinal").between(p.test_first, p.test_last), "test").when(F.col("ordinal") <= p.train_last, "train")
        out.append(fit_predict(ranked.withColumn("part", part), features, kind, least_rows, least_dates).withColumn("fold", F.lit(p.fold)))
    if not out:
        return ranked.withColumns({"fold": F.lit(0), "prediction": F.lit(0.0)}).limit(0).select(*names)
    return reduce(DataFrame.unionByName, out).select(*names)


def frozen_folds(plan: DataFrame, starts: DataFrame, horizon: int, embargo: int = 5) -> DataFrame:
    """starts(start): for each the newest fold that begins at or before it and whose training labels are mature by then."""
    both = starts.join(F.broadcast(plan), (F.col("test_first") <= F.col("start")) & (F.col("train_last") + horizon + embargo < F.col("start")))  # few folds
    best = both.groupBy("start").agg(F.max_by(F.struct("fold", "train_last"), "test_first").alias("f"))
    return starts.join(best, "start", "left").select("start", "f.fold", "f.train_last")


def momentum_scores(panel: DataFrame, lookback: int) -> DataFrame:
    """score: yesterday's return over `lookback` sessions, only if yesterday had volume."""
    before = F.try_divide(F.lag("close", 1).over(line()), F.lag("close", lookback + 1).over(line())) - 1
    return panel.withColumn("score", F.when(F.lag("volume", 1).over(line()) > 0, before))


def latest_ranking(scores: DataFrame, k: int) -> DataFrame:
    """The k best names on the last date that has scores: date, instrument, score, place."""
    known = scores.where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    last = known.agg(F.max("date").alias("date"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)), "instrument"))
    return known.join(F.broadcast(last), "date").withColumn("place", place).where(F.col("place") <= k).select("date", "instrument", "score", "place")


def chosen(trials: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """trials(keys, net_return, max_drawdown): the trial with the greatest net return less half the drawdown, and that
    objective; ties go to the smaller keys. by: one choice for each."""
    rows = trials.withColumn("objective", F.col("net_return") + 0.5 * F.col("max_drawdown"))
    best = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(F.round("objective", 9)), *keys))  # trials of a grid
    return rows.withColumn("_best", best).where("_best = 1").drop("_best")


def held_benchmark(panel: DataFrame, book: str, invested: float = 0.95) -> DataFrame:
    """book, date, equity from 1: `invested` split evenly over a book's names at their price in the book's first session
    and held; a name without a price then keeps its share as cash. Missing closes are carried forward."""
    rows = panel.select(F.col(book).cast("string").alias("book"), "date", "instrument", "close")
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(w)  # of the dense panel's first session, null where there is none
    last = F.last("close", ignorenulls=True).over(w)
    growth = F.when(first.isNotNull(), F.try_divide(last, first) - 1).otherwise(0.0)
    return rows.withColumn("growth", growth).groupBy("book", "date").agg((1 + invested * F.avg("growth")).alias("equity"))


def metrics(curve: DataFrame, by: str, risk_free: float = 0.04, days: float = 252.0) -> DataFrame:
    """Of curve(by, date, equity): total and annual return (365.25 days), Sharpe over the risk-free rate and Sortino
    (ddof 1), worst drawdown, Calmar, volatility; ratios without spread are 0."""
    w = Window.partitionBy(by).orderBy("date")
    rows = curve.withColumns({"ret": F.try_divide("equity", F.lag("equity", 1).over(w)) - 1, "peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    down, excess = F.when(F.col("ret") < 0, F.col("ret")), F.avg("ret") - risk_free / days
    a = rows.groupBy(by).agg(
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1 / 365.25)).alias("years"),
        F.coalesce(F.try_divide(excess, F.nullif(F.round(F.stddev_samp("ret"), 12), F.lit(0.0))) * days**0.5, F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(F.try_divide(excess, F.nullif(F.round(F.stddev_samp(down), 12), F.lit(0.0))) * days**0.5, F.lit(0.0)).alias("sortino_ratio"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"), (F.stddev_samp("ret") * days**0.5).alias("volatility"),
    )
    a = a.withColumn("annual_return", F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1)
    return a.withColumn("calmar_ratio", F.coalesce(F.try_divide("annual_return", F.abs(F.nullif("max_drawdown", F.lit(0.0)))), F.lit(0.0))).drop("years")


def gate_reasons(s: dict[str, Column]) -> Column:
    """Names of the rules that an experiment breaks, comma-joined. s: sessions, net_return, benchmark_return, max_drawdown,
    sharpe, good_folds (folds with a positive return), rank_ic, stale_sessions, stressed_return (at twice the costs)."""
    tests = {
        "sessions": s["sessions"] >= 126, "return": s["net_return"] > 0, "benchmark": s["net_return"] > s["benchmark_return"], "drawdown": s["max_drawdown"] >= -0.2,
        "sharpe": s["sharpe"] >= 0.5, "folds": s["good_folds"] >= 2, "rank_ic": s["rank_ic"] > 0, "stale": F.coalesce(s["stale_sessions"], F.lit(0)) == 0, "stress": s["stressed_return"] > 0,
    }
    return failed_rules(tests)


def calmar_like(sharpe: Column, drawdown: Column) -> Column:
    """Sharpe over the size of the worst drawdown; without a drawdown infinite for a positive Sharpe, else 0."""
    flat = (drawdown >= 0) | (F.abs(drawdown) < 1e-12)
    return F.when(sharpe.isNull() | F.isnan(sharpe), 0.0).when(flat, F.when(sharpe > 0, float("inf")).otherwise(0.0)).otherwise(sharpe / F.abs(drawdown))


def report_reasons(sharpe: Column, drawdown: Column, trades: Column, hold_drawdown: Column, least_sharpe: float = 0.0, worst: float = -0.25, least_trades: float = 4) -> Column:
    """Rules of a study's report that fail: Sharpe above a bound, a drawdown that is bounded or no worse than holding, trades."""
    return failed_rules({"sharpe": sharpe > least_sharpe, "drawdown": (drawdown >= worst) | (drawdown >= hold_drawdown), "trades": trades >= least_trades})


def promote_reasons(report: Column, sharpe: Column, drawdown: Column, hold_sharpe: Column, hold_drawdown: Column, good_bear_folds: Column, least_bear: int = 2) -> Column:
    """The report's reasons and two more: a Sharpe under holding's without an advantage in Calmar terms (two infinite ones
    are none), and fewer than `least_bear` bear folds within the drawdown bound."""
    own, hold, endless = calmar_like(sharpe, drawdown), calmar_like(hold_sharpe, hold_drawdown), F.lit(float("inf"))
    better = F.when(own == endless, hold != endless).when(hold == endless, False).otherwise(own >= hold)
    more = failed_rules({"lags holding": (sharpe >= hold_sharpe) | better, "bear folds": good_bear_folds >= least_bear})
    return F.array_join(F.filter(F.array(report, more), lambda r: r != ""), ",")


def good_bear_folds(folds: DataFrame, by: str, worst: float = -0.25) -> DataFrame:
    """by, good: bear folds(by, regime, max_drawdown, hold_drawdown) whose drawdown is bounded or no worse than holding."""
    good = (F.col("regime") == "bear") & ((F.col("max_drawdown") >= worst) | (F.col("max_drawdown") >= F.col("hold_drawdown")))
    return folds.groupBy(by).agg(F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias("good"))


def combined(studies: DataFrame, by: str) -> DataFrame:
    """One study of several: mean Sharpe, worst drawdown, trades added, the same of holding, and the parameters that most
    of them chose (the smaller of equally frequent ones)."""
    often = studies.groupBy(by, "params").agg(F.count("*").alias("n")).groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "params")).alias("p"))
    sums = studies.groupBy(by).agg(
        F.avg("sharpe").alias("sharpe"), F.min("max_drawdown").alias("max_drawdown"), F.sum("trades").alias("trades"), F.avg("hold_sharpe").alias("hold_sharpe"),
        F.min("hold_drawdown").alias("hold_drawdown"), F.sum("good_bear").alias("good_bear"), F.count("*").alias("studies"),
    )
    return sums.join(often.select(by, F.col("p.params").alias("params")), by)


def matured_ic(predictions: DataFrame, keys: list[str], x: str, y: str, by: str, least: int = 5) -> DataFrame:
    """daily_rank_ic() without each series' trailing days that have no coefficient yet."""
    daily = daily_rank_ic(predictions, keys, x, y, least)
    last = F.max(F.when(F.col("rank_ic").isNotNull(), F.col("date"))).over(Window.partitionBy(by))
    return daily.withColumn("_last", last).where("date <= _last").drop("_last")


def sliding_folds(rows: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """fold, first, last (ordinals of its test window) of rows(ordinal); each trains on the `train` sessions before."""
    size = F.max("ordinal") + 1
    count = F.floor((size - train - test) / step)
    return rows.agg(F.when(size >= train + test, F.sequence(F.lit(0), count.cast("int"))).alias("k")).select(F.explode("k").alias("fold")).select("fold", (train + F.col("fold") * step).alias("first"), (train + F.col("fold") * step + test - 1).alias("last"))


def _window_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    navs = rows.withColumn("nav", F.exp(F.sum(F.ln(1 + F.col("r"))).over(w))).withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(w)))
    sharpe = F.coalesce(F.try_divide(F.avg("r"), F.nullif(F.round(F.stddev_pop("r"), 12), F.lit(0.0))) * 252**0.5, F.lit(0.0))
    return navs.groupBy(*keys).agg(sharpe.alias("sharpe"), F.min(F.col("nav") / F.col("peak") - 1).alias("max_drawdown"), F.sum("trade").alias("trades"))


def walked(trials: DataFrame, folds: DataFrame, train: int, hold: str = "hold") -> DataFrame:
    """A study: trials(book, ordinal, params, ret, position) of a grid and of `hold`. In each fold the parameters with the
    best Sharpe (then the least drawdown) of the training window are scored on the test window, where signals are warm,
    beside holding: book, fold, params, sharpe, max_drawdown, trades, hold_sharpe, hold_drawdown, regime."""
    line = Window.partitionBy("book", "params").orderBy("ordinal")
    rows = trials.withColumns({"r": F.col("ret") * F.col("position"), "trade": F.abs(F.col("position") - F.coalesce(F.lag("position", 1).over(line), F.lit(0.0)))})
    spans = rows.join(F.broadcast(folds), F.col("ordinal").between(F.col("first") - train, F.col("last"))).withColumn("test", F.col("ordinal") >= F.col("first"))  # one row a fold
    stats = _window_stats(spans, ["book", "params", "fold", "test"])
    place = F.row_number().over(Window.partitionBy("book", "fold").orderBy(F.desc(F.round("sharpe", 9)), F.desc(F.round("max_drawdown", 9)), "params"))
    best = stats.where(~F.col("test") & (F.col("params") != hold)).withColumn("place", place).where("place = 1").select("book", "fold", "params")
    held = stats.where(F.col("test") & (F.col("params") == hold)).select("book", "fold", F.col("sharpe").alias("hold_sharpe"), F.col("max_drawdown").alias("hold_drawdown"))
    regime = F.when(F.col("hold_sharpe") > 0.5, "bull").when(F.col("hold_sharpe") < 0, "bear").otherwise("flat")
    return stats.where("test").drop("test").join(best, ["book", "fold", "params"]).join(held, ["book", "fold"]).withColumn("regime", regime)


def window_performance(curves: DataFrame, keys: list[str], ret: str = "net_return") -> DataFrame:
    """sessions, net_return, sharpe and max_drawdown of each curve, which starts from 1 at its first row."""
    rows = curves.withColumn("_curve", F.struct(*keys))
    return performance(rows, "_curve", ret).select("_curve.*", "sessions", "net_return", "sharpe", "max_drawdown")


def experiment(panel: DataFrame, scores: list[str], settings: list[tuple[int, int]], horizon: int = 5, buy: float = 0.0015, sell: float = 0.002) -> DataFrame:
    """One row for each score column of a dense panel: strategy, k, every, sessions, net_return, benchmark_return,
    max_drawdown, sharpe, good_folds, rank_ic, stale_sessions, stressed_return, reasons.

    The calendar alone gives validation and test sessions (calendar_folds). All settings of all scores are one grid of
    curves; each score takes the setting that is best on validation (chosen). Its test curve is then judged (gate_reasons)
    beside the whole universe held evenly, in its folds, at twice the costs, by the rank correlation of the score as it
    was known with what came `horizon` sessions later, and by the sessions on which something held had no close."""
    folds = cut(calendar_folds(panel))
    long = cut(panel.unpivot(["date", "instrument", "close", "volume"], scores, "strategy", "score"))
    curves, stale = [], []
    for name in scores:  # a few scores, each with all settings in one grid
        curves.append(top_k_grid(panel, name, settings, buy, sell).withColumn("strategy", F.lit(name)))
        stale.append(top_k_stale(panel, name, settings).withColumn("strategy", F.lit(name)))
    curve = cut(reduce(DataFrame.unionByName, curves).join(reduce(DataFrame.unionByName, stale), ["strategy", "k", "every", "date"]).join(F.broadcast(folds), "date"))  # one row a session
    keys = ["strategy", "k", "every"]
    tried = window_performance(curve.where("part = 'valid'"), keys)
    best = cut(chosen(tried, ["k", "every"], ["strategy"]).select(*keys))
    test = curve.where("fold is not null").join(F.broadcast(best), keys).withColumn("stressed", F.col("net_return") - F.col("cost"))  # one row a strategy
    main = window_performance(test, keys)
    stress = window_performance(test, ["strategy"], "stressed").select("strategy", F.col("net_return").alias("stressed_return"))
    good = window_performance(test, ["strategy", "fold"]).groupBy("strategy").agg(F.sum((F.col("net_return") > 0).cast("long")).alias("good_folds"))
    shut = test.groupBy("strategy").agg(F.sum((F.col("stale") > 0).cast("long")).alias("stale_sessions"))
    held = held_benchmark(panel.join(F.broadcast(folds.where("fold is not null").select("date")), "date").withColumn("book", F.lit("all")), "book")
    hold = held.agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("benchmark_return"))
    known = Window.partitionBy("strategy", "instrument").orderBy("date")
    asked = long.select("strategy", "date", F.lag("score", 1).over(known).alias("score"), (F.try_divide(F.lead("close", horizon).over(known), "close") - 1).alias("ahead"))
    daily = daily_rank_ic(asked.join(F.broadcast(folds.where("fold is not null").select("date")), "date"), ["strategy", "date"], "score", "ahead")
    ic = daily.groupBy("strategy").agg(F.avg("rank_ic").alias("rank_ic"))
    rows = main.crossJoin(F.broadcast(hold))  # one row
    for part in (stress, good, shut, ic):
        rows = rows.join(part, "strategy", "left")
    figures = ["sessions", "net_return", "benchmark_return", "max_drawdown", "sharpe", "good_folds", "rank_ic", "stale_sessions", "stressed_return"]
    return rows.withColumn("reasons", gate_reasons({c: F.col(c) for c in figures})).select(*keys, *figures, "reasons")
