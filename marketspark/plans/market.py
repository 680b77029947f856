"""Queries on indicators, signals, baskets and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators import indicators as T
from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators.evaluation import momentum_diagnosis
from marketspark.operators.lineage import cut
from marketspark.plans import duck
from marketspark.plans.factors import shown, shown_sql
from marketspark.plans.inputs import BARS, PANEL, bars, fills, panel, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINE = "PARTITION BY instrument ORDER BY date"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _show(*names: str) -> str:
    return ", ".join(map(shown_sql, names))


_PANEL = ("open", "high", "low", "close", "volume", "vwap", "returns", "industry", "cap")


@query(sql(PANEL, f"SELECT date, instrument, {_show(*_PANEL)} FROM panel"))
def panel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("date", "instrument", *map(shown, _PANEL))


@query(sql(BARS, f"SELECT instrument, date, {_show('open', 'high', 'low', 'close', 'volume', 'vwap')} FROM bars"))
def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument", "date", *map(shown, ("open", "high", "low", "close", "volume", "vwap")))


@query(sql(BARS, "SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM bars)"))
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calendar(bars(spark, sf_dir))


@query(sql(BARS, f"""
SELECT instrument, date, {shown_sql('close')} FROM (
  SELECT instrument, date, close * 1.01 AS close FROM bars WHERE date >= DATE '2000-01-01'
  UNION ALL SELECT instrument, date, close FROM bars WHERE date < DATE '2000-01-01')"""))
def upsert_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from 2000 on are overwritten by a later delivery."""
    old = bars(spark, sf_dir).select("instrument", "date", "close")
    return P.upsert(old, old.where("date >= '2000-01-01'").withColumn("close", F.col("close") * 1.01)).select("instrument", "date", shown("close"))


@query(sql(BARS, """
SELECT instrument, DATE '1994-01-01' AS "from", CAST(min(date) - INTERVAL 1 DAY AS DATE) AS "to" FROM bars GROUP BY instrument HAVING min(date) > DATE '1994-01-06'
UNION ALL SELECT instrument, CAST(max(date) + INTERVAL 1 DAY AS DATE), DATE '2002-01-31' FROM bars GROUP BY instrument HAVING max(date) < DATE '2002-01-26'"""))
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_ranges(bars(spark, sf_dir), "1994-01-01", "2002-01-31")


@query()
def failover_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    primary = b.where("date >= '1995-02-01' or instrument < 'NATION_2'").select("instrument", "date", "close")
    return P.failover(primary, b.select("instrument", "date", F.col("vwap").alias("close")), "1995-01-01").select("instrument", "date", shown("close"))


ORACLES["failover_bars"] = sql(BARS + """,
lines AS (SELECT instrument, date, close, min(date) OVER (PARTITION BY instrument) AS first FROM bars WHERE date >= DATE '1995-02-01' OR instrument < 'NATION_2'),
good AS (SELECT DISTINCT instrument FROM lines WHERE first <= DATE '1995-01-11'),
picked AS (SELECT instrument, date, close FROM lines WHERE instrument IN (SELECT instrument FROM good)
  UNION ALL SELECT instrument, date, vwap AS close FROM bars WHERE instrument NOT IN (SELECT instrument FROM good))""", f"SELECT instrument, date, {shown_sql('close')} FROM picked")


@query(sql(PANEL, f"""
SELECT date, instrument, {shown_sql('close')} FROM (
  SELECT date, instrument, last_value(close IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM panel)"""))
def carried_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of alignment: each session's last known close."""
    p = panel(spark, sf_dir)
    return P.carried(p.where("close is not null").select("instrument", "date", "close"), p.select("date"), "instrument", "close").select("date", "instrument", shown("close"))


_FIRST = {"sma_10": "mean|10|close", "sma_30": "mean|30|close", "vol_mean": "mean|20|volume", "bb_mid": "mean|20|close", "bb_std": "std|20|close"}
_F1 = ", ".join(f"{duck.rolling(v.split('|')[0], int(v.split('|')[1]), v.split('|')[2])} AS {n}" for n, v in _FIRST.items())
_INDICATORS = PANEL + f""", f1 AS (
  SELECT *, {_F1}, close / nullif(lag(close, 20) OVER ({LINE}), 0) - 1 AS momentum_20, lag(close) OVER ({LINE}) AS before FROM panel
), f2 AS (
  SELECT *, volume / nullif(vol_mean, 0) AS volume_ratio, greatest(high - low, abs(high - before), abs(low - before)) AS true_range, close / nullif(before, 0) - 1 AS daily,
         bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower, (close - bb_mid) / nullif(bb_std * 2, 0) AS bb_pct FROM f1
), features AS (
  SELECT *, {duck.rolling('mean', 14, 'true_range')} AS atr_14, {duck.rolling('std', 20, 'daily')} * sqrt(252) AS volatility_20 FROM f2
)"""
_FEATURES = ("sma_10", "sma_30", "momentum_20", "volume_ratio", "true_range", "bb_mid", "bb_upper", "bb_lower", "bb_pct", "atr_14", "volatility_20")


@query(sql(_INDICATORS, f"SELECT date, instrument, {_show(*_FEATURES)} FROM features"))
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(panel(spark, sf_dir)).select("date", "instrument", *map(shown, _FEATURES))


@query()
def indicators_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.smoothed(bars(spark, sf_dir)).select("instrument", "date", *map(shown, ("ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi")))


def _ema(alpha: float, x: str) -> str:
    """The recursion over a whole history as a fold of its list."""
    return f"list_reduce({x}, lambda a, b: {1 - alpha!r} * a + {alpha!r} * b)"


ORACLES["indicators_smoothed"] = sql(BARS + f""", seq AS (
  SELECT instrument, date, close, coalesce(close - lag(close) OVER ({LINE}), 0) AS move FROM bars
), hist AS (
  SELECT instrument, date, list(close) OVER w AS closes, list(greatest(move, 0.0)) OVER w AS ups, list(greatest(-move, 0.0)) OVER w AS downs
  FROM seq WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), e1 AS (
  SELECT instrument, date, {_ema(2 / 13, 'closes')} AS ema_12, {_ema(2 / 27, 'closes')} AS ema_26, {_ema(1 / 14, 'ups')} AS up, {_ema(1 / 14, 'downs')} AS down FROM hist
), e2 AS (
  SELECT *, ema_12 - ema_26 AS macd, list(ema_12 - ema_26) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS macds FROM e1
), e3 AS (
  SELECT *, {_ema(2 / 10, 'macds')} AS macd_signal, CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100.0 END AS rsi FROM e2
), e4 AS (SELECT *, macd - macd_signal AS macd_hist FROM e3)""", f"SELECT instrument, date, {_show('ema_12', 'ema_26', 'macd', 'macd_signal', 'macd_hist', 'rsi')} FROM e4")

_SIGNALS = _INDICATORS + f""", sides AS (
  SELECT *, CASE WHEN lag(sma_10) OVER ({LINE}) <= lag(sma_30) OVER ({LINE}) AND sma_10 > sma_30 THEN 'buy'
                 WHEN lag(sma_10) OVER ({LINE}) >= lag(sma_30) OVER ({LINE}) AND sma_10 < sma_30 THEN 'sell' ELSE 'hold' END AS side FROM features
), positions AS (
  SELECT *, CASE WHEN last_value(CASE WHEN side <> 'hold' THEN side END IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'buy' THEN 1 ELSE 0 END AS position FROM sides
)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.features(panel(spark, sf_dir)).withColumn("side", T.cross_side("sma_10", "sma_30"))
    return rows.withColumn("position", T.held("side"))


@query(sql(_SIGNALS, "SELECT date, instrument, side, position FROM positions"))
def signals_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("date", "instrument", "side", "position")


@query(sql(_SIGNALS + f""", timed AS (
  SELECT instrument, date, abs(position - coalesce(lag(position) OVER ({LINE}), 0)) AS change,
    position * (lead(close) OVER ({LINE}) / nullif(close, 0) - 1) AS c, position * (lead(open, 2) OVER ({LINE}) / nullif(lead(open) OVER ({LINE}), 0) - 1) AS o FROM positions
)""", "SELECT instrument, count(*) AS n, round(avg(o - 0.001 * change) * 1.000000001, 7) AS next_open, round(avg(c - 0.001 * change) * 1.000000001, 7) AS same_close, round((avg(o - 0.001 * change) - avg(c - 0.001 * change)) * 1.000000001, 7) AS delta FROM timed GROUP BY instrument"))
def fill_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return of the cross signal under both fill timings."""
    rows = R.signal_backtest(_positions(spark, sf_dir))
    both = rows.groupBy("instrument").agg(F.count("*").alias("n"), F.avg("next_open").alias("o"), F.avg("same_close").alias("c"))
    return both.select("instrument", "n", F.round(F.col("o") * 1.000000001, 7).alias("next_open"), F.round(F.col("c") * 1.000000001, 7).alias("same_close"), F.round((F.col("o") - F.col("c")) * 1.000000001, 7).alias("delta"))


@query(sql(_INDICATORS + f""", t AS (
  SELECT *, lag(close, 4) OVER ({LINE}) / nullif(lag(close, 26) OVER ({LINE}), 0) - 1 AS trend,
    CASE WHEN lead(date) OVER ({LINE}) IS NOT NULL THEN date_trunc('month', lead(date) OVER ({LINE})) <> date_trunc('month', date) ELSE last_day(date) - date <= 4 END AS month_end FROM features
)""", f"""SELECT date, instrument, {shown_sql('trend')}, month_end,
  CAST(floor(1e6 * least(0.15 / greatest(volatility_20, 0.05), 1.5) * CASE WHEN trend > 0 THEN 1.0 ELSE 0.4 END / nullif(close, 0)) AS BIGINT) AS units FROM t"""))
def signals_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.features(panel(spark, sf_dir)).withColumns({"trend": T.skipped_momentum(26, 4), "month_end": T.month_end()})
    units = T.trend_size(1e6, "close", "volatility_20", "trend")
    return rows.select("date", "instrument", shown("trend"), "month_end", units.cast("long").alias("units"))


@query(sql(BARS, f"""SELECT instrument, date, {_show('close', 'previous', 'change', 'percent')} FROM (
  SELECT *, close - previous AS change, CASE WHEN previous = 0 THEN 0.0 ELSE (close - previous) / previous * 100 END AS percent
  FROM (SELECT instrument, date, close, lag(close) OVER ({LINE}) AS previous, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS n FROM bars) WHERE n = 1)"""))
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quotes(bars(spark, sf_dir)).select("instrument", "date", *map(shown, ("close", "previous", "change", "percent")))


_INDEX = PANEL + """, idx AS (
  SELECT CAST(CAST(industry AS DOUBLE) AS VARCHAR) AS book, date, coalesce(avg(CASE WHEN returns IS NOT NULL THEN greatest(least(returns, 1.0), -0.5) END), 0) AS ret FROM panel GROUP BY 1, 2
), idx_nav AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM idx)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight index of each region; single returns are clipped, for the prices are of mixed goods."""
    clipped = panel(spark, sf_dir).withColumn("returns", F.when(F.col("returns").isNotNull(), F.greatest(F.least("returns", F.lit(1.0)), F.lit(-0.5))))
    return R.equal_weight_index(clipped, "industry")


@query(sql(_INDEX, f"SELECT book, date, {_show('ret', 'nav')} FROM idx_nav"))
def basket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("book", "date", *map(shown, ("ret", "nav")))


@query(sql(_INDEX + """, peaks AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM idx_nav),
perf AS (SELECT book, count(*) AS sessions, arg_max(nav, date) - 1 AS net_return, avg(ret) / nullif(round(stddev_pop(ret), 12), 0) * sqrt(252) AS sharpe, min(nav / peak - 1) AS max_drawdown FROM peaks GROUP BY book)""",
    f"SELECT book, sessions, {_show('net_return', 'sharpe', 'max_drawdown')} FROM perf"))
def basket_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.performance(_index(spark, sf_dir), "book", "ret").select("book", "sessions", *map(shown, ("net_return", "sharpe", "max_drawdown")))


_B = "PARTITION BY book ORDER BY date"


@query(sql(_INDEX + f""", m AS (
  SELECT *, lag(nav, 4) OVER ({_B}) / nullif(lag(nav, 26) OVER ({_B}), 0) - 1 AS mom,
    CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM idx_nav WINDOW w AS ({_B} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), s AS (
  SELECT *, CASE WHEN mom IS NULL THEN 0.0 WHEN mom > 0 THEN 0.9 ELSE 0.4 END AS base, CASE WHEN vol IS NULL THEN 1.0 ELSE least(1.5, 0.15 / greatest(vol, 0.05)) END AS scale FROM m
), sleeves AS (SELECT *, CASE WHEN mom > 0 THEN least(CASE WHEN mom >= 0.2 THEN 0.95 ELSE 0.9 END, base * scale) ELSE least(base, base * scale) END AS sleeve FROM s)""", f"SELECT book, date, {_show('mom', 'vol', 'sleeve')} FROM sleeves"))
def basket_sleeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book").orderBy("date")
    last = w.rowsBetween(-19, 0)
    rows = _index(spark, sf_dir).withColumns({"mom": F.try_divide(F.lag("nav", 4).over(w), F.lag("nav", 26).over(w)) - 1, "vol": F.when(F.count("ret").over(last) == 20, F.stddev_samp("ret").over(last) * 252**0.5)})
    return rows.withColumn("sleeve", R.sleeve(F.col("mom"), F.col("vol"))).select("book", "date", *map(shown, ("mom", "vol", "sleeve")))


@query(sql(_INDICATORS + """, v AS (
  SELECT date, instrument, industry, 1 / greatest(coalesce(volatility_20, quantile_cont(volatility_20, 0.5) OVER (PARTITION BY date)), 0.05) AS inv FROM features
), w AS (SELECT date, instrument, 0.9 * inv / nullif(sum(inv) OVER (PARTITION BY date), 0) AS weight FROM v)""", f"SELECT date, instrument, {shown_sql('weight')} FROM w"))
def weights_inverse_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.features(panel(spark, sf_dir))
    return R.inverse_vol_weights(rows, ["date"], "volatility_20", F.lit(0.9)).select("date", "instrument", shown("weight"))


_SCORES = _INDEX + f""", z AS (
  SELECT *, count(nav) OVER w AS n, avg(nav) OVER w AS mu, stddev_samp(nav) OVER w AS sd FROM idx_nav WINDOW w AS ({_B} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
), scores AS (SELECT book, date, CASE WHEN n >= 40 THEN greatest(least((nav - mu) / nullif(round(sd, 12), 0), 2.0), -2.0) END AS score FROM z),
filled AS (SELECT *, coalesce(score, 0) AS s FROM scores),
tw AS (SELECT book, date, score, CASE WHEN max(s) OVER d < -0.5 THEN 0.4 / count(*) OVER d WHEN max(s) OVER d - min(s) OVER d < 0.25 THEN 1.0 / count(*) OVER d
  ELSE exp(greatest(least(s, 2.0), -2.0)) / sum(exp(greatest(least(s, 2.0), -2.0))) OVER d END AS weight FROM filled WINDOW d AS (PARTITION BY date))"""


@query(sql(_SCORES, f"SELECT book, date, {_show('score', 'weight')} FROM tw"))
def theme_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).withColumn("score", R.zscore_window(F.col("nav"), "book"))
    return rows.withColumn("weight", R.theme_weights(F.col("score"), ["date"])).select("book", "date", *map(shown, ("score", "weight")))


@query(sql(PANEL + f""", d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM panel)),
r AS (SELECT p.*, d.ordinal, lag(-returns) OVER (PARTITION BY instrument ORDER BY p.date) AS signal, abs(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY p.date), 0) - 1) AS move,
  coalesce(lead(close) OVER (PARTITION BY instrument ORDER BY p.date) / nullif(close, 0) - 1, 0) AS ahead FROM panel p JOIN d ON p.date = d.date),
t AS (SELECT *, coalesce(close IS NOT NULL AND volume > 0 AND move < 9.0 AND signal IS NOT NULL, false) AS ok FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN ok THEN round(signal, 9) END DESC NULLS LAST, instrument) AS place FROM t),
g AS (SELECT *, CASE WHEN ordinal % 4 = 0 THEN CASE WHEN ok AND place <= 5 THEN 0.2 ELSE 0.0 END END AS target FROM k),
w AS (SELECT *, coalesce(last_value(target IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS weight FROM g),
c AS (SELECT *, weight - coalesce(lag(weight) OVER ({LINE}), 0) AS change FROM w),
curve AS (SELECT date, sum(weight * ahead) AS gross, sum(abs(change)) AS turnover, sum(CASE WHEN change > 0 THEN change * 0.0015 ELSE -change * 0.002 END) AS cost FROM c GROUP BY date),
net AS (SELECT date, gross - cost AS net_return, turnover, cost FROM curve)""", f"SELECT date, {_show('net_return', 'turnover')}, round(cost * 1.000000001, 7) AS cost FROM net"))
def top_k_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("reversal", -F.col("returns"))
    return R.top_k_curve(p, "reversal").select("date", *map(shown, ("net_return", "turnover")), F.round(F.col("cost") * 1.000000001, 7).alias("cost"))


@query(sql(_INDEX + """, n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS ordinal FROM idx_nav),
f AS (SELECT i AS fold, 104 + i * 26 AS first, 104 + i * 26 + 25 AS last FROM range(0, 1000) t(i) WHERE 104 + i * 26 + 26 <= (SELECT count(DISTINCT date) FROM panel)),
s AS (SELECT book, fold, count(*) AS sessions, exp(sum(ln(1 + ret))) - 1 AS net_return, avg(ret) / nullif(round(stddev_samp(ret), 12), 0) * sqrt(252) AS sharpe FROM n JOIN f ON ordinal BETWEEN first AND last GROUP BY book, fold)""",
    f"SELECT book, CAST(fold AS INTEGER) AS fold, sessions, {_show('net_return', 'sharpe')}, CASE WHEN sharpe > 0.5 THEN 'bull' WHEN sharpe < 0 THEN 'bear' ELSE 'flat' END AS regime FROM s"))
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test windows of sliding folds over session ordinals, each index scored in each."""
    rows = cut(_index(spark, sf_dir))
    number = rows.select("date").distinct().count()
    plan = F.broadcast(spark.createDataFrame(R.folds(number), "fold int, first int, last int"))  # one row per half year
    n = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("book").orderBy("date")) - 1)
    scored = n.join(plan, F.col("ordinal").between(F.col("first"), F.col("last"))).groupBy("book", "fold").agg(
        F.count("*").alias("sessions"), (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("net_return"), (F.try_divide(F.avg("ret"), F.nullif(F.round(F.stddev_samp("ret"), 12), F.lit(0.0))) * 252**0.5).alias("sharpe")
    )
    regime = F.when(F.col("sharpe") > 0.5, "bull").when(F.col("sharpe") < 0, "bear").otherwise("flat").alias("regime")
    return scored.select("book", "fold", "sessions", shown("net_return"), shown("sharpe"), regime)


@query()
def momentum_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum_diagnosis(_index(spark, sf_dir)).select("book", F.col("n").cast("long"), *map(shown, ("ic", "on_share", "on_mean", "off_mean", "spread")))


@query(sql(BARS, "SELECT instrument, date, count(*) AS lines, round(sum(amount), 2) AS amount FROM fills GROUP BY instrument, date"))
def fills_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy("instrument", "date").agg(F.count("*").alias("lines"), F.round(F.sum("amount"), 2).alias("amount"))
