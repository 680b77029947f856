"""Baskets, weights and the evaluation of portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.panel import line
from marketspark.operators.scan import LONG, Run, lengthy, scanned


def product_over(x: Column, w) -> Column:
    """Running product of 1 + x; a loss of all or more is zero from there on."""
    return F.when(F.min(1 + x).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(1 + x > 0, 1 + x))).over(w)))


def equal_weight_index(panel: DataFrame, book: str) -> DataFrame:
    """book, date, ret (mean of the known returns, none: 0), nav. One row per session before the running product."""
    daily = panel.groupBy(F.col(book).cast("string").alias("book"), "date").agg(F.coalesce(F.avg("returns"), F.lit(0.0)).alias("ret"))
    return daily.withColumn("nav", product_over(F.col("ret"), Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def vol_scale(vol: Column, target: float = 0.15, floor: float = 0.05, cap: float = 1.5) -> Column:
    """target over realised volatility, capped; an unknown volatility changes nothing, an infinite one closes."""
    return F.when(vol.isNull() | F.isnan(vol), 1.0).when(vol == float("inf"), 0.0).otherwise(F.least(F.lit(cap), F.lit(target) / F.greatest(vol, F.lit(floor))))


def sleeve(momentum: Column, vol: Column, on: float = 0.9, off: float = 0.4, strong: float = 0.95, hurdle: float = 0.2) -> Column:
    """Invested share: on or off by momentum, scaled by volatility; only a strong momentum may fill up to `strong`."""
    base = F.when(momentum.isNull(), 0.0).when(momentum > 0, on).otherwise(off)
    scaled = base * vol_scale(vol)
    return F.when(momentum > 0, F.least(F.when(momentum >= hurdle, strong).otherwise(on), scaled)).otherwise(F.least(base, scaled))


def inverse_vol_weights(rows: DataFrame, keys: list[str], vol: str, share: Column, floor: float = 0.05) -> DataFrame:
    """weight: the share split by inverse volatility; an unknown one counts as the median of the known."""
    day = Window.partitionBy(*keys)
    v = F.greatest(F.coalesce(vol, F.percentile(vol, F.lit(0.5)).over(day)), F.lit(floor))
    return rows.withColumn("_v", 1 / v).withColumn("weight", share * F.try_divide(F.col("_v"), F.sum("_v").over(day))).drop("_v")


def theme_weights(score: Column, keys: list[str], cash: float = -0.5, invested: float = 0.4, band: float = 0.25) -> Column:
    """Softmax of scores clipped to two; equal if their spread is under the band; 40 % if even the best is low."""
    day = Window.partitionBy(*keys)
    s = F.coalesce(score, F.lit(0.0))
    n, top = F.count(F.lit(1)).over(day), F.max(s).over(day)
    soft = F.exp(F.greatest(F.least(s, F.lit(2.0)), F.lit(-2.0)))
    even = (top - F.min(s).over(day)) < band
    return F.when(top < cash, F.lit(invested) / n).when(even, F.lit(1.0) / n).otherwise(soft / F.sum(soft).over(day))


def zscore_window(x: Column, by: str, window: int = 252, least: int = 40) -> Column:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(1 - window, 0)
    z = F.try_divide(x - F.avg(x).over(w), F.nullif(F.round(F.stddev_samp(x).over(w), 12), F.lit(0.0)))
    return F.when((F.count(x).over(w) >= least) & z.isNotNull(), F.greatest(F.least(z, F.lit(2.0)), F.lit(-2.0)))


def weighted_score(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts(keys, z, w): sum of w * z over the sum of |w| of the known parts; null if none is known."""
    known = F.when(F.col("z").isNotNull(), F.abs("w"))
    return parts.groupBy(*keys).agg(F.try_divide(F.sum(F.col("z") * F.col("w")), F.sum(known)).alias("score"))


def top_k_curve(panel: DataFrame, score: str, k: int = 5, every: int = 4, buy: float = 0.0015, sell: float = 0.002, limit: float = 9.0) -> DataFrame:
    """date, net_return, turnover, cost of an equal-weight top-k portfolio.

    On every `every`-th session the tradable names with the highest lagged score are held at 1 / k until the next one.
    Weights do not drift and turnover is not capped: a restatement of the sequential rule as a table job."""
    w = line()
    days = panel.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)
    before, after = F.lag("close", 1).over(w), F.lead("close", 1).over(w)
    rows = panel.withColumns({"signal": F.lag(score, 1).over(w), "move": F.abs(F.try_divide("close", before) - 1), "ahead": F.coalesce(F.try_divide(after, "close") - 1, F.lit(0.0))})
    rows = rows.join(F.broadcast(days), "date")  # one row per session
    tradable = F.col("close").isNotNull() & (F.col("volume") > 0) & (F.col("move") < limit) & F.col("signal").isNotNull()
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(F.when(tradable, F.round("signal", 9))), "instrument"))
    turn = F.col("ordinal") % every == 0
    rows = rows.withColumn("place", place).withColumn("target", F.when(turn, F.when(tradable & (F.col("place") <= k), 1.0 / k).otherwise(0.0)))
    rows = rows.withColumn("weight", F.coalesce(F.last("target", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    rows = rows.withColumn("change", F.col("weight") - F.coalesce(F.lag("weight", 1).over(w), F.lit(0.0)))
    cost = F.when(F.col("change") > 0, F.col("change") * buy).otherwise(-F.col("change") * sell)
    daily = rows.groupBy("date").agg(F.sum(F.col("weight") * F.col("ahead")).alias("gross"), F.sum(F.abs("change")).alias("turnover"), F.sum(cost).alias("cost"))
    return daily.select("date", (F.col("gross") - F.col("cost")).alias("net_return"), "turnover", "cost")


def _grid(panel: DataFrame, score: str, settings: list[tuple[int, int]], limit: float) -> DataFrame:
    """Every name's weight and its change on every session for every setting (k, every)."""
    w = line()
    days = panel.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)
    before, after = F.lag("close", 1).over(w), F.lead("close", 1).over(w)
    rows = panel.withColumns({"signal": F.lag(score, 1).over(w), "move": F.abs(F.try_divide("close", before) - 1), "ahead": F.coalesce(F.try_divide(after, "close") - 1, F.lit(0.0))})
    tradable = F.col("close").isNotNull() & (F.col("volume") > 0) & (F.col("move") < limit) & F.col("signal").isNotNull()
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(F.when(tradable, F.round("signal", 9))), "instrument"))
    ranked = rows.join(F.broadcast(days), "date").select("date", "instrument", "ordinal", "ahead", "close", F.when(tradable, place).alias("place"))  # one row a session
    met = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(every).alias("every")) for k, every in settings]))
    each = ranked.withColumn("s", met).select("s.*", "date", "instrument", "ordinal", "ahead", "close", "place")
    own = Window.partitionBy("k", "every", "instrument").orderBy("date")
    target = F.when(F.col("ordinal") % F.col("every") == 0, F.when(F.col("place") <= F.col("k"), 1.0 / F.col("k")).otherwise(0.0))
    each = each.withColumn("target", target).withColumn("weight", F.coalesce(F.last("target", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return each.withColumn("change", F.col("weight") - F.coalesce(F.lag("weight", 1).over(own), F.lit(0.0)))


def top_k_grid(panel: DataFrame, score: str, settings: list[tuple[int, int]], buy: float = 0.0015, sell: float = 0.002, limit: float = 9.0) -> DataFrame:
    """top_k_curve() of many settings (k, every) at once: k, every, date, net_return, turnover, cost.

    Names are ranked once; each ranked row is then met by the settings, rows of a list, so the panel is read and sorted
    once however many they are."""
    each = _grid(panel, score, settings, limit)
    cost = F.when(F.col("change") > 0, F.col("change") * buy).otherwise(-F.col("change") * sell)
    daily = each.groupBy("k", "every", "date").agg(F.sum(F.col("weight") * F.col("ahead")).alias("gross"), F.sum(F.abs("change")).alias("turnover"), F.sum(cost).alias("cost"))
    return daily.select("k", "every", "date", (F.col("gross") - F.col("cost")).alias("net_return"), "turnover", "cost")


def top_k_stale(panel: DataFrame, score: str, settings: list[tuple[int, int]], limit: float = 9.0) -> DataFrame:
    """k, every, date, stale: the names that are held on a session without a close."""
    return _grid(panel, score, settings, limit).groupBy("k", "every", "date").agg(F.sum(((F.col("weight") != 0) & F.col("close").isNull()).cast("long")).alias("stale"))


def performance(curve: DataFrame, by: str, ret: str = "net_return", long: int = LONG) -> DataFrame:
    """Per book: sessions, net_return, sharpe (ddof 0, 252 sessions), max_drawdown from an initial 1. Curves of over `long`
    points are worked on in slices (scan); a return of -1 or less ends in a nav of nothing."""
    long = lengthy(curve, [by], long)
    rows = curve.withColumn("_lost", (1 + F.col(ret) <= 0).cast("int"))
    runs = {"_log": Run("sum", F.when(1 + F.col(ret) > 0, F.ln(1 + F.col(ret)))), "_out": Run("max", F.col("_lost"))}
    nav = F.when(F.col("_out") == 1, 0.0).otherwise(F.exp("_log"))
    rows = scanned(scanned(rows, [by], ["date"], runs, long).withColumn("nav", nav), [by], ["date"], {"_peak": Run("max", F.col("nav"))}, long).withColumn("peak", F.greatest(F.lit(1.0), "_peak"))
    return rows.groupBy(by).agg(
        F.count("*").alias("sessions"), (F.max_by("nav", "date") - 1).alias("net_return"),
        F.try_divide(F.avg(ret), F.nullif(F.round(F.stddev_pop(ret), 12), F.lit(0.0))).alias("_s"), F.min(F.col("nav") / F.col("peak") - 1).alias("max_drawdown"),
    ).withColumn("sharpe", F.col("_s") * 252**0.5).drop("_s")


def signal_backtest(rows: DataFrame, cost: float = 0.001) -> DataFrame:
    """instrument, date, next_open, same_close: returns of the position under both fill timings, costs on changes."""
    w = line()
    change = F.abs(F.col("position") - F.coalesce(F.lag("position", 1).over(w), F.lit(0)))
    at_close = F.col("position") * (F.try_divide(F.lead("close", 1).over(w), "close") - 1) - cost * change
    at_open = F.col("position") * (F.try_divide(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1) - cost * change
    return rows.select("instrument", "date", at_open.alias("next_open"), at_close.alias("same_close"))


def folds(sessions: int, train: int = 104, test: int = 26, step: int = 26) -> list[tuple[int, int, int]]:
    """fold, first and last session ordinal of its test window; each trains on the `train` sessions before."""
    return [(i, s, s + test - 1) for i, s in enumerate(range(train, sessions - test + 1, step))]


def quality_targets(rows: DataFrame, keys: list[str], sleeve: Column, mode: str = "inv_vol", vol: str = "vol", mom: str = "mom") -> DataFrame:
    """weight: the sleeve(of each key) split evenly (equal), by inverse volatility (inv_vol) or by momentum and volatility
    (dual_mom); without a sleeve all weights are 0."""
    from marketspark.operators.desk import dual_momentum

    if mode == "equal":
        out = rows.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    elif mode == "dual_mom":
        out = dual_momentum(rows, keys, mom, vol, 1.0)
    elif mode == "inv_vol":
        out = inverse_vol_weights(rows, keys, vol, F.lit(1.0))
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.withColumn("weight", F.when(sleeve > 0, sleeve * F.col("weight")).otherwise(0.0))
