"""The 101 published formulaic alphas as expressions of `algebra`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketspark.functions.algebra import Expr, evaluate, parse

# The formulas with their window lengths and weights, in order.
_TABLE = """
001 rank(argmax(spow(where(returns < 0, std(returns, 20), close), 2), 5)) - 0.5
002 -corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)
003 -corr(rank(open), rank(volume), 10)
004 -trank(rank(low), 9)
005 rank(open - mean(vwap, 10)) * -abs(rank(close - vwap))
006 -corr(open, volume, 10)
007 where(adv(20) < volume, -trank(abs(delta(close, 7)), 60) * sign(delta(close, 7)), -1)
008 -rank(tsum(open, 5) * tsum(returns, 5) - delay(tsum(open, 5) * tsum(returns, 5), 10))
009 where(tmin(delta(close, 1), 5) > 0, delta(close, 1), where(tmax(delta(close, 1), 5) < 0, delta(close, 1), -delta(close, 1)))
010 rank(where(tmin(delta(close, 1), 4) > 0, delta(close, 1), where(tmax(delta(close, 1), 4) < 0, delta(close, 1), -delta(close, 1))))
011 (rank(tmax(vwap - close, 3)) + rank(tmin(vwap - close, 3))) * rank(delta(volume, 3))
012 sign(delta(volume, 1)) * -delta(close, 1)
013 -rank(cov(rank(close), rank(volume), 5))
014 -rank(delta(returns, 3)) * corr(open, volume, 10)
015 -tsum(rank(corr(rank(high), rank(volume), 3)), 3)
016 -rank(cov(rank(high), rank(volume), 5))
017 -rank(trank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(trank(volume / adv(20), 5))
018 -rank(std(abs(close - open), 5) + (close - open) + corr(close, open, 10))
019 -sign(close - delay(close, 7) + delta(close, 7)) * (1 + rank(1 + tsum(returns, 250)))
020 -rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))
021 where(mean(close, 8) + std(close, 8) < mean(close, 2), -1, where(mean(close, 2) < mean(close, 8) - std(close, 8), 1, where(volume / adv(20) >= 1, 1, -1)))
022 -(delta(corr(high, volume, 5), 5) * rank(std(close, 20)))
023 where(mean(high, 20) < high, -delta(high, 2), 0)
024 where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -(close - tmin(close, 100)), -delta(close, 3))
025 rank(-returns * adv(20) * vwap * (high - close))
026 -tmax(corr(trank(volume, 5), trank(high, 5), 5), 3)
027 where(rank(mean(corr(rank(volume), rank(vwap), 6), 2)) > 0.5, -1, 1)
028 scale(corr(adv(20), low, 5) + (high + low) / 2 - close)
029 smaller(product(rank(rank(log(tsum(rank(rank(scale(tmin(rank(rank(-rank(delta(close - 1, 5)))), 2)))), 1)))), 5), trank(delay(-returns, 6), 5)) + trank(delay(-returns, 6), 5)
030 (1 - rank(sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3)))) * tsum(volume, 5) / tsum(volume, 20)
031 rank(rank(rank(decay(-rank(rank(delta(close, 10))), 10)))) + rank(-delta(close, 3)) + sign(scale(corr(adv(20), low, 12)))
032 scale(mean(close, 7) - close) + 20 * scale(corr(vwap, delay(close, 5), 230))
033 rank(-(1 - open / close))
034 rank(1 - rank(std(returns, 2) / std(returns, 5)) + (1 - rank(delta(close, 1))))
035 trank(volume, 32) * (1 - trank(close + high - low, 16)) * (1 - trank(returns, 32))
036 2.21 * rank(corr(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(trank(delay(-returns, 6), 5)) + rank(abs(corr(vwap, adv(20), 6))) + 0.6 * rank((mean(close, 200) - open) * (close - open))
037 rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)
038 -rank(trank(close, 10)) * rank(close / open)
039 -rank(delta(close, 7) * (1 - rank(decay(volume / adv(20), 9)))) * (1 + rank(tsum(returns, 250)))
040 -rank(std(high, 10)) * corr(high, volume, 10)
041 (high * low) ** 0.5 - vwap
042 rank(vwap - close) / rank(vwap + close)
043 trank(volume / adv(20), 20) * trank(-delta(close, 7), 8)
044 -corr(high, rank(volume), 5)
045 -(rank(mean(delay(close, 5), 20)) * corr(close, volume, 2) * rank(corr(tsum(close, 5), tsum(close, 20), 2)))
046 where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 > 0.25, -1, where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < 0, 1, -(close - delay(close, 1))))
047 rank(1 / close) * volume / adv(20) * (high * rank(high - close) / mean(high, 5)) - rank(vwap - delay(vwap, 5))
048 neutral(corr(delta(close, 1), delta(delay(close, 1), 1), 250) * delta(close, 1) / close, industry) / tsum((delta(close, 1) / delay(close, 1)) ** 2, 250)
049 where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.1, 1, -(close - delay(close, 1)))
050 -tmax(rank(corr(rank(volume), rank(vwap), 5)), 5)
051 where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.05, 1, -(close - delay(close, 1)))
052 (delay(tmin(low, 5), 5) - tmin(low, 5)) * rank((tsum(returns, 240) - tsum(returns, 20)) / 220) * trank(volume, 5)
053 -delta((close - low - (high - close)) / (close - low), 9)
054 -((low - close) * open ** 5) / ((low - high) * close ** 5)
055 -corr(rank((close - tmin(low, 12)) / (tmax(high, 12) - tmin(low, 12))), rank(volume), 6)
056 -(rank(tsum(returns, 10) / tsum(tsum(returns, 2), 3)) * rank(returns * cap))
057 -((close - vwap) / decay(rank(argmax(close, 30)), 2))
058 -trank(decay(corr(neutral(vwap, industry), volume, 4), 8), 6)
059 -trank(decay(corr(neutral(vwap * 0.728317 + vwap * (1 - 0.728317), industry), volume, 4), 16), 8)
060 -(2 * scale(rank((close - low - (high - close)) / (high - low) * volume)) - scale(rank(argmax(close, 10))))
061 flag(rank(vwap - tmin(vwap, 16)) < rank(corr(vwap, adv(180), 18)))
062 0 - flag(rank(corr(vwap, tsum(adv(20), 22), 10)) < rank(flag(rank(open) + rank(open) < rank((high + low) / 2) + rank(high))))
063 -(rank(decay(delta(neutral(close, industry), 2), 8)) - rank(decay(corr(vwap * 0.318108 + open * (1 - 0.318108), tsum(adv(180), 37), 14), 12)))
064 0 - flag(rank(corr(tsum(open * 0.178404 + low * (1 - 0.178404), 13), tsum(adv(120), 13), 17)) < rank(delta((high + low) / 2 * 0.178404 + vwap * (1 - 0.178404), 4)))
065 0 - flag(rank(corr(open * 0.00817205 + vwap * (1 - 0.00817205), tsum(adv(60), 9), 6)) < rank(open - tmin(open, 14)))
066 -(rank(decay(delta(vwap, 4), 7)) + trank(decay((low - vwap) / (open - (high + low) / 2), 11), 7))
067 -rank(high - tmin(high, 2)) ** rank(corr(neutral(vwap, industry), neutral(adv(20), industry), 6))
068 0 - flag(trank(corr(rank(high), rank(adv(15)), 9), 14) < rank(delta(close * 0.518371 + low * (1 - 0.518371), 1)))
069 -rank(tmax(delta(neutral(vwap, industry), 3), 5)) ** trank(corr(close * 0.490655 + vwap * (1 - 0.490655), adv(20), 5), 9)
070 -rank(delta(vwap, 1)) ** trank(corr(neutral(close, industry), adv(50), 18), 18)
071 larger(trank(decay(corr(trank(close, 3), trank(adv(180), 12), 18), 4), 16), trank(decay(rank(low + open - (vwap + vwap)) ** 2, 16), 4))
072 rank(decay(corr((high + low) / 2, adv(40), 9), 10)) / rank(decay(corr(trank(vwap, 4), trank(volume, 19), 7), 3))
073 -larger(rank(decay(delta(vwap, 5), 3)), trank(decay(-(delta(open * 0.147155 + low * (1 - 0.147155), 2) / (open * 0.147155 + low * (1 - 0.147155))), 3), 17))
074 0 - flag(rank(corr(close, tsum(adv(30), 37), 15)) < rank(corr(rank(high * 0.0261661 + vwap * (1 - 0.0261661)), rank(volume), 11)))
075 flag(rank(corr(vwap, volume, 4)) < rank(corr(rank(low), rank(adv(50)), 12)))
076 -larger(rank(decay(delta(vwap, 1), 12)), trank(decay(delta(neutral(low, industry), 1) / neutral(low, industry), 15), 6))
077 smaller(rank(decay((high + low) / 2 + high - (vwap + high), 20)), rank(decay(corr((high + low) / 2, adv(40), 3), 6)))
078 rank(corr(tsum(low * 0.352233 + vwap * (1 - 0.352233), 20), tsum(adv(40), 20), 7)) ** rank(corr(rank(vwap), rank(volume), 6))
079 rank(delta(neutral(close * 0.60733 + open * (1 - 0.60733), industry), 1.2) / tmin(neutral(close * 0.60733 + open * (1 - 0.60733), industry), 4)) * rank(corr(vwap, adv(150), 4))
080 -rank(sign(delta(neutral(open, industry), 1.5))) ** trank(corr(high, adv(50), 4), 4)
081 0 - flag(rank(log(product(rank(rank(corr(vwap, tsum(adv(10), 50), 8)) ** 4), 15))) < rank(corr(rank(vwap), rank(volume), 5)))
082 -smaller(rank(decay(delta(open, 1.4), 15)), trank(decay(corr(neutral(volume, industry), open * 0.634 + open * (1 - 0.634), 17), 7), 13))
083 rank(delay((high - low) / mean(close, 5), 2)) * rank(rank(volume)) / ((high - low) / mean(close, 5) / (vwap - close))
084 spow(trank(vwap - tmax(vwap, 15), 21), delta(close, 5))
085 rank(corr(high * 0.876703 + close * (1 - 0.876703), adv(30), 10)) ** rank(corr(trank((high + low) / 2, 4), trank(volume, 10), 7))
086 0 - flag(trank(corr(close, tsum(adv(20), 15), 6), 20) < rank(delta(close, 3)))
087 -(rank(decay(delta(vwap, 4), 7)) + trank(decay((low * 0.9 + low * 0.1 - vwap) / (neutral(open, industry) - (high + low) / 2), 11), 11))
088 smaller(rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), trank(decay(corr(trank(close, 8), trank(adv(60), 21), 8), 7), 3))
089 trank(decay(corr(neutral(vwap, industry), adv(15), 5), 3), 3) ** rank(decay(delta(close * 0.57 + open * 0.43, 3), 16))
090 -rank(trank(decay(corr(neutral(close, industry), adv(50), 8), 17), 18))
091 trank(decay(decay(corr(neutral(close, industry), volume, 10), 16), 4), 5) - rank(decay(corr(vwap, adv(30), 4), 3))
092 smaller(trank(decay(flag((high + low) / 2 + close < low + open), 15), 19), trank(decay(corr(rank(low), rank(adv(30)), 8), 7), 7))
093 trank(decay(corr(neutral(vwap, industry), adv(81), 17), 20), 8) ** rank(decay((close + open) / 2 - vwap, 18))
094 -rank(vwap - tmin(vwap, 12)) ** trank(corr(trank(vwap, 20), trank(adv(60), 4), 18), 3)
095 flag(rank(open - tmin(open, 12)) < trank(rank(corr(tsum((high + low) / 2, 19), tsum(adv(40), 19), 13)) ** 5, 12))
096 -larger(trank(decay(corr(rank(vwap), rank(volume), 4), 4), 8), trank(decay(argmax(corr(trank(close, 7), trank(adv(60), 4), 4), 13), 14), 13))
097 -rank(decay(delta(neutral(low, industry), 2), 8)) ** trank(decay(corr(rank(low), rank(adv(60)), 8), 6), 13)
098 rank(decay(corr(vwap, tsum(adv(5), 26), 5), 7)) - rank(decay(trank(argmin(corr(rank(open), rank(adv(15)), 21), 9), 7), 8))
099 0 - flag(rank(corr(tsum((high + low) / 2, 20), tsum(adv(60), 20), 9)) < rank(corr(low, volume, 6)))
100 -rank(neutral(corr(close, trank(adv(20), 5), 5) - rank(argmin(close, 30)), industry))
101 (close - open) / (high - low + 0.001)
"""

FORMULAS: dict[str, str] = dict(line.split(" ", 1) for line in _TABLE.strip().splitlines())


def expression(alpha_id: str, sign: float = 1.0) -> Expr:
    if alpha_id not in FORMULAS:
        raise KeyError(f"unknown alpha {alpha_id}")
    return parse(FORMULAS[alpha_id]) * sign if sign != 1 else parse(FORMULAS[alpha_id])


def needs(alpha_id: str) -> set[str]:
    """Optional fields (industry, cap) that an alpha cannot do without."""
    return {f for f in ("industry", "cap") if f in FORMULAS[alpha_id].replace("(", " ").replace(")", " ").replace(",", " ").split()}


def registry() -> list[tuple[str, str, list[str]]]:
    """alpha_id, formula, optional fields needed."""
    return [(a, f, sorted(needs(a))) for a, f in FORMULAS.items()]


def compute(panel: DataFrame, ids: list[str], sign: dict[str, float] | None = None) -> DataFrame:
    """date, instrument and one column alpha_<id> for each alpha; all of them share their common steps.

    panel: dense on calendar x instruments, with FIELDS; an alpha that needs an absent field raises ValueError."""
    for a in ids:
        if absent := needs(a) - set(panel.columns):
            raise ValueError(f"alpha {a} requires {', '.join(sorted(absent))}")
    return evaluate(panel, {f"alpha_{a}": expression(a, (sign or {}).get(a, 1.0)) for a in ids}, ["date", "instrument"])
