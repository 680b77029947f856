"""Option tables: expiries, strikes and Black-Scholes marks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution in JVM expressions, as Spark has no error function: the rational form whose absolute
    error is under 7.5e-8."""
    # The published coefficients.
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def third_friday(month: Column) -> Column:
    """The third Friday of a date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(month, "month"), 1), "Fri"), 14)


def atm_strike(spot: Column) -> Column:
    """Nearest step (0.5 under 25, 1 under 200, else 5), halves to even."""
    step = F.when(spot < 25, 0.5).when(spot < 200, 1.0).otherwise(5.0)
    return F.bround(spot / step) * step


def occ_tag(symbol: Column, expiry: Column, strike: Column) -> Column:
    return F.concat(F.upper(symbol), F.date_format(expiry, "yyMMdd"), F.lit("C"), F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def call(spot: Column, strike: Column, days: Column, vol: Column, rate: float = 0.04) -> dict[str, Column]:
    """premium and delta of a European call; at no days left its intrinsic value."""
    t = days / 365.0
    spread = vol * F.sqrt(t)
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * t) / F.nullif(spread, F.lit(0.0))
    live = (days > 0) & (spread > 0)
    premium = spot * normal_cdf(d1) - strike * F.exp(-rate * t) * normal_cdf(d1 - spread)
    return {"premium": F.when(live, premium).otherwise(F.greatest(spot - strike, F.lit(0.0))), "delta": F.when(live, normal_cdf(d1)).otherwise((spot > strike).cast("double"))}


def chosen_expiry(expiries: Column, day: Column, least: int = 21, most: int = 90) -> Column:
    """Of an array of dates the nearest with `least` to `most` days left, else the nearest that is not over."""
    open_ = F.filter(expiries, lambda e: F.datediff(e, day) >= 0)
    return F.coalesce(F.array_min(F.filter(open_, lambda e: F.datediff(e, day).between(least, most))), F.array_min(open_))


def standard_expiry(expiries: Column, day: Column, least: int = 21, most: int = 90, longest: bool = False) -> Column:
    """Of an array of dates one with `least` days left or more: of those up to `most` days the nearest or the longest, of
    later ones, if there are no others, likewise; null if all are too near."""
    far = F.filter(expiries, lambda e: F.datediff(e, day) >= least)
    band = F.filter(far, lambda e: F.datediff(e, day) <= most)
    pick = F.array_max if longest else F.array_min
    return F.coalesce(pick(band), pick(far))
