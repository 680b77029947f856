"""Technical indicators and trading signals, per instrument along its sessions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.algebra import rolling
from marketspark.operators.panel import line


def momentum(x: str, n: int) -> Column:
    return F.try_divide(x, F.lag(x, n).over(line())) - 1


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    c = F.col("close")
    mid, std = rolling("mean", n, c), rolling("std", n, c)
    return {"bb_mid": mid, "bb_upper": mid + k * std, "bb_lower": mid - k * std, "bb_pct": F.try_divide(c - mid, std * k)}


def true_range() -> Column:
    """The largest of the known distances; on the first session high less low."""
    before = F.lag("close", 1).over(line())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


#: Name -> column of the registry; windows of a column that is itself windowed are taken in a second select.
FEATURES: dict[str, Callable[[], Column]] = {
    "sma_10": lambda: rolling("mean", 10, F.col("close")),
    "sma_30": lambda: rolling("mean", 30, F.col("close")),
    "momentum_20": lambda: momentum("close", 20),
    "volume_ratio": lambda: F.try_divide("volume", rolling("mean", 20, F.col("volume"))),
    "true_range": true_range,
    "daily": lambda: momentum("close", 1),
}
SECOND: dict[str, Callable[[], Column]] = {
    "atr_14": lambda: rolling("mean", 14, F.col("true_range")),
    "volatility_20": lambda: rolling("std", 20, F.col("daily")) * (252**0.5),
}


def features(panel: DataFrame, first: dict | None = None, second: dict | None = None) -> DataFrame:
    """Every registered feature in two selects of one partitioning."""
    out = panel.withColumns({n: f() for n, f in (first or FEATURES).items()} | bollinger())
    return out.withColumns({n: f() for n, f in (SECOND if second is None else second).items()})


def smoothed(bars: DataFrame, rsi: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """instrument, date, ema_12, ema_26, macd, macd_signal, macd_hist, rsi of observed bars.

    Exponential means are recursive, so one instrument's history (bounded by the calendar) goes to a pandas helper. The
    first difference counts as zero; without losses the RSI is 100 if there were gains, else missing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
        move = pdf["close"].diff().fillna(0.0)
        up, down = (m.ewm(alpha=1 / rsi, adjust=False).mean() for m in (move.clip(lower=0), -move.clip(upper=0)))
        pdf["ema_12"], pdf["ema_26"] = mean(pdf["close"], fast), mean(pdf["close"], slow)
        pdf["macd"] = pdf["ema_12"] - pdf["ema_26"]
        pdf["macd_signal"] = mean(pdf["macd"], signal)
        pdf["macd_hist"] = pdf["macd"] - pdf["macd_signal"]
        pdf["rsi"] = (100 - 100 / (1 + up / down.where(down > 0))).where(down > 0, other=(up > 0).map({True: 100.0, False: float("nan")}))
        return pdf[["instrument", "date", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi"]]

    schema = "instrument string, date date, ema_12 double, ema_26 double, macd double, macd_signal double, macd_hist double, rsi double"
    return bars.where("close is not null").select("instrument", "date", "close").groupBy("instrument").applyInPandas(run, schema)


def cross_side(fast: str, slow: str) -> Column:
    """buy when fast goes from at or under slow to over it, sell when from at or over to under, else hold."""
    was_fast, was_slow = F.lag(fast, 1).over(line()), F.lag(slow, 1).over(line())
    buy = (was_fast <= was_slow) & (F.col(fast) > F.col(slow))
    sell = (was_fast >= was_slow) & (F.col(fast) < F.col(slow))
    return F.when(buy, "buy").when(sell, "sell").otherwise("hold")


def reversion_side(rsi: str = "rsi", low: float = 30, high: float = 70) -> Column:
    return F.when(F.col(rsi) < low, "buy").when(F.col(rsi) > high, "sell").otherwise("hold")


def book_action(cross: str, fast: str, slow: str, rsi: str) -> dict[str, Column]:
    """A cross down sells first; an up-trend buys; else the RSI decides. mode says which rule spoke."""
    down, up = F.col(cross) == "sell", F.col(fast) > F.col(slow)
    side = F.when(down, "sell").when(up, "buy").otherwise(reversion_side(rsi))
    return {"action": side, "mode": F.when(down, "cross").when(up, "trend").otherwise("reversion")}


def held(action: str = "action") -> Column:
    """1 while long, 0 while flat: the last action that was not hold."""
    last = F.last(F.when(F.col(action) != "hold", F.col(action)), ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(last == "buy", 1).otherwise(0)


def skipped_momentum(lookback: int, skip: int, x: str = "close") -> Column:
    return F.try_divide(F.lag(x, skip).over(line()), F.lag(x, lookback).over(line())) - 1


def trend_size(equity: float, price: str, vol: str, mom: str, target: float = 0.15, floor: float = 0.05, cap: float = 1.5, risk_off: float = 0.4) -> Column:
    """Whole units of a volatility-targeted position, reduced while momentum is not positive."""
    scale = F.least(F.lit(target) / F.greatest(F.col(vol), F.lit(floor)), F.lit(cap))
    return F.floor(F.try_divide(equity * scale * F.when(F.col(mom) > 0, 1.0).otherwise(risk_off), price))


def month_end(date: str = "date") -> Column:
    """The last session of its month; for the newest, at most four days before the month's end."""
    after = F.lead(date, 1).over(line())
    return F.when(after.isNotNull(), F.trunc(after, "month") != F.trunc(date, "month")).otherwise(F.datediff(F.last_day(date), date) <= 4)


def quotes(bars: DataFrame) -> DataFrame:
    """Latest and previous close of each instrument, change and percent (0 where the previous is 0)."""
    w = line()
    rows = bars.where("close is not null").withColumns({"previous": F.lag("close", 1).over(w), "_last": F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("date")))}).where("_last = 1")
    change = F.col("close") - F.col("previous")
    return rows.select("instrument", "date", "close", "previous", change.alias("change"), F.when(F.col("previous") == 0, 0.0).otherwise(F.try_divide(change, "previous") * 100).alias("percent"))
