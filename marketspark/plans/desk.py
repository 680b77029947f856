"""Queries on desk work, options, audits and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators import desk as K
from marketspark.operators import indicators as T
from marketspark.operators import options as X
from marketspark.operators import overlays as V
from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators import records as C
from marketspark.operators.lineage import cut
from marketspark.plans.factors import EDGE, shown, shown_sql
from marketspark.plans.inputs import BARS, PANEL, bars, panel, sql, table
from marketspark.plans.market import _INDEX, _INDICATORS, LINE, _ema, _index, _show
from marketspark.plans.records import _TRADES, _trades
from marketspark.sources import stores
from marketspark.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql(BARS, "SELECT n_name AS instrument FROM nation WHERE n_name NOT IN (SELECT instrument FROM bars WHERE date < DATE '1995-01-09')"))
def universe_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a bar in the first week."""
    return P.absent(table(spark, sf_dir, "nation").select(F.col("n_name").alias("instrument")), bars(spark, sf_dir).where("date < '1995-01-09'"))


@query(sql(BARS, "SELECT instrument, min(date) AS first FROM bars WHERE close > 1500 GROUP BY instrument HAVING min(date) > DATE '1995-01-06'"))
def late_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.late_starts(bars(spark, sf_dir).where("close > 1500"), "1995-01-01", 5)


@query(sql(BARS, "SELECT instrument, min(date) AS first, max(date) AS last FROM bars GROUP BY instrument"))
def instrument_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("instrument").agg(F.min("date").alias("first"), F.max("date").alias("last"))


@query(sql(PANEL, f"SELECT instrument, count(close) AS bars, max(date) FILTER (close IS NOT NULL) AS last, {shown_sql('avg(CASE WHEN close > 0 THEN 1.0 ELSE 0.0 END)').rsplit(' AS ', 1)[0]} AS share, avg(CASE WHEN close > 0 THEN 1.0 ELSE 0.0 END) >= 0.95 AS enough FROM panel GROUP BY instrument"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage(panel(spark, sf_dir)).select("instrument", "bars", "last", shown("share"), "enough")


_RSI = f""", seq AS (SELECT instrument, date, coalesce(close - lag(close) OVER ({LINE}), 0) AS move FROM bars),
hist AS (SELECT instrument, date, list(greatest(move, 0.0)) OVER w AS ups, list(greatest(-move, 0.0)) OVER w AS downs FROM seq WINDOW w AS ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
strength AS (SELECT instrument, date, {_ema(1 / 14, 'ups')} AS up, {_ema(1 / 14, 'downs')} AS down FROM hist),
rsis AS (SELECT instrument, date, CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100.0 END AS rsi FROM strength),
acts AS (SELECT f.date, f.instrument, r.rsi, sma_10, sma_30,
  CASE WHEN lag(sma_10) OVER (PARTITION BY f.instrument ORDER BY f.date) >= lag(sma_30) OVER (PARTITION BY f.instrument ORDER BY f.date) AND sma_10 < sma_30 THEN 1 ELSE 0 END AS down
  FROM features f LEFT JOIN rsis r ON r.instrument = f.instrument AND r.date = f.date)"""


@query(sql(_INDICATORS + _RSI, """SELECT date, instrument, CASE WHEN down = 1 THEN 'sell' WHEN sma_10 > sma_30 THEN 'buy' WHEN rsi < 30 THEN 'buy' WHEN rsi > 70 THEN 'sell' ELSE 'hold' END AS action,
  CASE WHEN down = 1 THEN 'cross' WHEN sma_10 > sma_30 THEN 'trend' ELSE 'reversion' END AS mode FROM acts"""))
def book_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rsi = T.smoothed(bars(spark, sf_dir)).select("instrument", "date", "rsi")
    rows = T.features(panel(spark, sf_dir)).join(rsi, ["instrument", "date"], "left").withColumn("cross", T.cross_side("sma_10", "sma_30"))
    return rows.withColumns(T.book_action("cross", "sma_10", "sma_30", "rsi")).select("date", "instrument", "action", "mode")


_DUAL = _INDICATORS + f""", v AS (SELECT date, instrument, CASE WHEN momentum_20 > 0 THEN momentum_20 END AS m, 1 / greatest(coalesce(volatility_20, quantile_cont(volatility_20, 0.5) OVER (PARTITION BY date)), 0.05) AS inv FROM features),
w AS (SELECT date, instrument, 0.9 * CASE WHEN count(m) OVER d = 0 THEN inv / nullif(sum(inv) OVER d, 0)
  ELSE coalesce(0.5 * m / sum(m) OVER d + 0.5 * CASE WHEN m IS NOT NULL THEN inv END / nullif(sum(CASE WHEN m IS NOT NULL THEN inv END) OVER d, 0), 0) END AS weight FROM v WINDOW d AS (PARTITION BY date))"""


def _dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dual_momentum(T.features(panel(spark, sf_dir)), ["date"], "momentum_20", "volatility_20")


@query(sql(_DUAL, f"SELECT date, instrument, {shown_sql('weight')} FROM w"))
def weights_dual_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir).select("date", "instrument", shown("weight"))


@query(sql(_DUAL + ", e AS (SELECT date, sum(abs(weight)) AS gross, max(abs(weight)) AS largest, CAST(sum(CASE WHEN weight <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS names FROM w GROUP BY date)", f"SELECT date, {_show('gross', 'largest')}, names FROM e"))
def book_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.exposure(_dual(spark, sf_dir)).select("date", *map(shown, ("gross", "largest")), "names")


@query(sql(_DUAL + ", e AS (SELECT date, sum(abs(weight)) AS gross FROM w GROUP BY date), y AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS sessions, quantile_cont(round(gross, 6), 0.5) AS median, quantile_cont(round(gross, 6), 0.95) AS p95 FROM e GROUP BY 1)",
    f"SELECT year, sessions, {_show('median', 'p95')}, CASE WHEN sessions < 40 THEN 'sessions' ELSE '' END AS failed FROM y"))
def exposure_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = K.exposure(_dual(spark, sf_dir)).withColumn("gross", F.round("gross", 6))
    return K.exposure_gates(daily).select("year", "sessions", *map(shown, ("median", "p95")), "failed")


_OVERLAY = _DUAL + f""", days AS (SELECT date, CAST(year(date) AS INTEGER) AS book, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM panel)),
opened AS (SELECT book, date FROM days WHERE ordinal % 13 <> 5 AND NOT (book % 2 = 0 AND ordinal % 17 = 3)),
marks AS (SELECT date, CASE WHEN round(avg(returns), 9) >= 0 THEN 1.0 WHEN avg(returns) IS NOT NULL THEN 0.0 END AS label FROM panel GROUP BY date),
lagged AS (SELECT o.book, o.date, lag(label) OVER (PARTITION BY book ORDER BY o.date) AS label FROM opened o LEFT JOIN marks m ON m.date = o.date),
daily AS (SELECT CAST(year(date) AS INTEGER) AS book, date, round(sum(abs(weight)), 6) AS gross, max(abs(weight)) AS peak FROM w WHERE weight IS NOT NULL GROUP BY date),
held AS (SELECT d.book, max(gross - CASE WHEN label IS NULL THEN NULL WHEN label <> 0 THEN 0.95 ELSE 0.7 END) AS over, max(peak) AS peak FROM daily d JOIN opened o ON o.date = d.date LEFT JOIN lagged l ON l.date = d.date GROUP BY d.book),
metric AS (SELECT book, round(gross / 0.9, 6) AS metric, CASE WHEN book % 3 = 0 THEN 0.008 ELSE gross END AS baseline, gross > 0 AS eligible FROM daily),
figures AS (SELECT book, quantile_cont(metric, 0.5) AS median, quantile_cont(baseline, 0.5) AS base_median, quantile_cont(metric, 0.95) AS p95, quantile_cont(baseline, 0.95) AS base_p95, count(*) FILTER (eligible) AS days,
  count(*) FILTER (eligible AND (metric < 0.5 - 1e-12 OR metric > 1.5 + 1e-12)) AS outside FROM metric GROUP BY book),
all_ AS (SELECT b.book, over, peak, CASE WHEN b.book % 7 <> 0 THEN CASE WHEN b.book % 2 = 0 THEN 25 ELSE 3 END END AS n, median, CASE WHEN base_median < 0.01 THEN 0.05 ELSE 1.5 * base_median END AS median_limit, p95, CASE WHEN base_p95 < 0.02 THEN 0.1 ELSE 2.5 * base_p95 END AS p95_limit,
  coalesce(days, 0) AS days, outside, CASE WHEN b.book % 4 = 1 THEN 1e-6 ELSE 0.0 END AS unlabeled, -(b.book % 5) / 10.0 AS max_drawdown
  FROM (SELECT DISTINCT book FROM days) b LEFT JOIN held h ON h.book = b.book LEFT JOIN figures f ON f.book = b.book),
capped AS (SELECT *, CASE WHEN n > 0 THEN least(1.0 / n + 0.05, 0.4) ELSE 0.0 END AS cap FROM all_)"""


@query(sql(_OVERLAY, f"""SELECT book, array_to_string(list_filter([CASE WHEN abs(max_drawdown) > 0.2 + 1e-12 THEN 'halt' END, CASE WHEN over > 1e-12 THEN 'exposure' END, CASE WHEN peak IS NOT NULL AND n IS NULL THEN 'size' END, CASE WHEN n IS NOT NULL AND peak > cap + 1e-12 THEN 'weight' END,
  CASE WHEN median > median_limit + 1e-12 THEN 'median' END, CASE WHEN p95 > p95_limit + 1e-12 THEN 'p95' END, CASE WHEN days < 40 THEN 'evidence' END, CASE WHEN days >= 40 AND outside > 0 THEN 'band' END, CASE WHEN unlabeled > 1e-12 THEN 'derivatives' END], lambda r: r IS NOT NULL), ',') AS failed,
  {_show('over', 'peak', 'cap', 'median', 'median_limit', 'p95', 'p95_limit')}, days FROM capped"""))
def overlay_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's weights as a book: every 13th session is a holiday, even years are suspended on some, labels say whether
    the mean return was not negative."""
    p = panel(spark, sf_dir)
    book = F.year("date").alias("book")
    days = p.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1).select("*", book)  # one row a session
    opened = V.open_sessions(days, days.where("ordinal % 13 = 5"), days.where("book % 2 = 0 and ordinal % 17 = 3"))
    mean = F.avg("returns")
    labels = p.groupBy("date").agg(F.when(F.round(mean, 9) >= 0, 1.0).when(mean.isNotNull(), 0.0).alias("label")).select("*", book)
    weights = cut(K.dual_momentum(T.features(p), ["date"], "momentum_20", "volatility_20").select("date", "instrument", "weight", book))
    daily = weights.where("weight is not null").groupBy("book", "date").agg(F.round(F.sum(F.abs("weight")), 6).alias("gross"))
    daily = daily.select("book", "date", F.round(F.col("gross") / 0.9, 6).alias("metric"), F.when(F.col("book") % 3 == 0, 0.008).otherwise(F.col("gross")).alias("baseline"), (F.col("gross") > 0).alias("eligible"))
    books = days.select("book").distinct()
    targets = books.where("book % 7 <> 0").select("book", F.when(F.col("book") % 2 == 0, 25).otherwise(3).alias("n"))
    totals = books.select("book", F.when(F.col("book") % 4 == 1, 1e-6).otherwise(0.0).alias("unlabeled"), (-(F.col("book") % 5) / 10.0).alias("max_drawdown"))
    rows = V.overlay_gates(weights, opened, V.lagged_labels(opened, labels), targets, daily, totals)
    return rows.select("book", "failed", *map(shown, ("over", "peak", "cap", "median", "median_limit", "p95", "p95_limit")), "days")


@query(sql(PANEL + """, t AS (SELECT instrument, arg_max(close, date) AS price, arg_min(volume, date) AS held FROM bars GROUP BY instrument),
r AS (SELECT instrument, CASE WHEN instrument < 'NATION_2' THEN CAST(floor(1e6 * 0.05 / price) AS BIGINT) ELSE 0 END AS wanted, CAST(held AS BIGINT) AS held FROM t)""",
    "SELECT instrument, wanted, held, wanted - held AS delta FROM r WHERE wanted <> held AND (held = 0 OR abs(wanted - held) / CAST(abs(held) AS DOUBLE) > 0.05 OR wanted = 0)"))
def rebalance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before NATION_2 get five per cent each; first volumes are read as what is held."""
    rows = bars(spark, sf_dir).groupBy("instrument").agg(F.max_by("close", "date").alias("price"), F.min_by("volume", "date").alias("quantity"))
    return K.rebalance(rows.where("instrument < 'NATION_2'").select("instrument", F.lit(0.05).alias("weight"), "price"), rows.select("instrument", "quantity"), 1e6)


@query(sql(_INDEX + ", c AS (SELECT a.book AS a, b.book AS b, covar_pop(a.ret, b.ret) / nullif(sqrt(var_pop(a.ret)) * sqrt(var_pop(b.ret)), 0) AS corr, count(*) AS n FROM idx a JOIN idx b ON a.date = b.date AND a.book < b.book GROUP BY 1, 2)", f"SELECT a, b, {shown_sql('corr')}, n FROM c"))
def book_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.correlations(_index(spark, sf_dir)).select("a", "b", shown("corr"), "n")


_GRID = [(lookback, skip) for lookback in (13, 26, 52) for skip in (0, 4)]


@query(sql(_INDEX + ", " + "g AS (" + " UNION ALL ".join(f"SELECT book, {a} AS lookback, {b} AS skip, ret * CASE WHEN lag(nav, {b + 1}) OVER (PARTITION BY book ORDER BY date) / nullif(lag(nav, {a + 1}) OVER (PARTITION BY book ORDER BY date), 0) > 1 THEN 1.0 ELSE 0.0 END AS r FROM idx_nav" for a, b in _GRID) +
    "), s AS (SELECT book, lookback, skip, avg(r) / nullif(round(stddev_pop(r), 12), 0) * sqrt(252) AS sharpe FROM g GROUP BY book, lookback, skip)",
    f"SELECT book, lookback, skip, {shown_sql('sharpe')} FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(sharpe, 9) DESC, lookback, skip) AS n FROM s) WHERE n = 1"))
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best momentum lookback and skip of each book by Sharpe; signals of all pairs come from one pass."""
    w = Window.partitionBy("book").orderBy("date")
    on = {f"r{a}_{b}": F.col("ret") * F.when(F.try_divide(F.lag("nav", b + 1).over(w), F.lag("nav", a + 1).over(w)) > 1, 1.0).otherwise(0.0) for a, b in _GRID}
    tried = F.explode(F.array(*[F.struct(F.lit(a).alias("lookback"), F.lit(b).alias("skip"), F.col(f"r{a}_{b}").alias("r")) for a, b in _GRID]))
    rows = _index(spark, sf_dir).withColumns(on).select("book", tried.alias("g")).select("book", "g.*")
    s = rows.groupBy("book", "lookback", "skip").agg((F.try_divide(F.avg("r"), F.nullif(F.round(F.stddev_pop("r"), 12), F.lit(0.0))) * 252**0.5).alias("sharpe"))
    best = F.row_number().over(Window.partitionBy("book").orderBy(F.desc(F.round("sharpe", 9)), "lookback", "skip"))
    return s.withColumn("n", best).where("n = 1").select("book", "lookback", "skip", shown("sharpe"))


@query()
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed net return of the top-k book at one and two times its costs."""
    p = panel(spark, sf_dir).withColumn("reversal", -F.col("returns"))
    once, twice = (R.top_k_curve(p, "reversal", buy=0.0015 * k, sell=0.002 * k).agg(F.lit(k).alias("times"), F.sum("net_return").alias("net"), F.sum("cost").alias("cost")) for k in (1, 2))
    return once.union(twice).select("times", shown("net"), shown("cost"))


@query(sql(BARS, """SELECT month, CAST(month + CAST((5 - dayofweek(month) + 7) % 7 + 14 AS INTEGER) AS DATE) AS expiry FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM bars)"""))
def third_fridays(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = bars(spark, sf_dir).select(F.trunc("date", "month").alias("month")).distinct()
    return months.select("month", X.third_friday(F.col("month")).alias("expiry"))


# The published coefficients of the rational form.
_CDF = "(CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END)"
_TAIL = "(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"


def _cdf_sql(x: str) -> str:
    return _CDF.format(x=x, t=_TAIL.format(x=x, k=f"(1 / (1 + 0.2316419 * abs({x})))"))


@query(sql(_INDICATORS + f""", o AS (SELECT instrument, date, close, greatest(volatility_20, 0.12) AS vol, CASE WHEN close < 25 THEN 0.5 WHEN close < 200 THEN 1.0 ELSE 5.0 END AS step,
  CAST(date_trunc('month', date + INTERVAL 1 MONTH) AS DATE) AS month FROM features WHERE close IS NOT NULL AND volatility_20 IS NOT NULL),
e AS (SELECT *, round_even(close / step, 0) * step AS strike, CAST(month + CAST((5 - dayofweek(month) + 7) % 7 + 14 AS INTEGER) AS DATE) AS expiry FROM o),
t AS (SELECT *, date_diff('day', date, expiry) / 365.0 AS t FROM e),
p AS (SELECT *, (ln(close / strike) + (0.04 + vol * vol / 2) * t) / nullif(vol * sqrt(t), 0) AS d1, vol * sqrt(t) AS spread FROM t),
m AS (SELECT *, {_cdf_sql('d1')} AS n1, {_cdf_sql('(d1 - spread)')} AS n2 FROM p)""",
    f"""SELECT instrument, date, upper(instrument) || strftime(expiry, '%y%m%d') || 'C' || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS tag, strike,
  {_show('premium', 'delta')} FROM (SELECT *, CASE WHEN t > 0 AND spread > 0 THEN close * n1 - strike * exp(-0.04 * t) * n2 ELSE greatest(close - strike, 0.0) END AS premium, CASE WHEN t > 0 AND spread > 0 THEN n1 ELSE CAST(close > strike AS DOUBLE) END AS delta FROM m)"""))
def option_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-the-money calls on every bar, to the third Friday of the next month, at the name's own volatility (12 % at least)."""
    rows = T.features(panel(spark, sf_dir)).where("close is not null and volatility_20 is not null")
    rows = rows.withColumns({"strike": X.atm_strike(F.col("close")), "expiry": X.third_friday(F.add_months("date", 1)), "vol": F.greatest("volatility_20", F.lit(0.12))})
    marks = X.call(F.col("close"), F.col("strike"), F.datediff("expiry", "date"), F.col("vol"))
    return rows.select("instrument", "date", X.occ_tag(F.col("instrument"), F.col("expiry"), F.col("strike")).alias("tag"), F.col("strike"), *[c.alias(n) for n, c in marks.items()]).withColumns({n: shown(n) for n in marks})


_DATED = _TRADES.replace("round(l_extendedprice / l_quantity, 4) AS price,", "round(l_extendedprice / l_quantity, 4) AS price, CAST(l_shipdate AS DATE) AS date,")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).withColumn("date", F.to_date("at.l_shipdate"))


@query(sql(_DATED, "SELECT book, symbol, sum(CASE WHEN date <= DATE '1998-01-01' THEN signed ELSE 0 END) AS holding, round(sum(CASE WHEN date <= DATE '1998-01-01' THEN -signed * price - fee ELSE 0 END) * 1.000000001, -2) AS cash FROM costs GROUP BY book, symbol"))
def holdings_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.holdings_at(_dated(spark, sf_dir), F.lit("1998-01-01").cast("date")).select("book", "symbol", "holding", F.round(F.col("cash") * EDGE, -2).alias("cash"))


@query(sql(_DATED + """, d AS (SELECT book, date, count(*) AS fills, sum(fee) AS fees, sum(-signed * price - fee) AS flow FROM costs GROUP BY book, date),
c AS (SELECT *, sum(flow) OVER (PARTITION BY book ORDER BY date) AS cash FROM d), b AS (SELECT *, cash - greatest(0.0, max(cash) OVER (PARTITION BY book ORDER BY date)) AS below FROM c)""",
    "SELECT book, date, fills, round(fees * 1.000000001, 1) AS fees, round(cash * 1.000000001, -3) AS cash, round(below * 1.000000001, -3) AS below FROM b"))
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daily_ledger(_dated(spark, sf_dir)).select("book", "date", "fills", F.round(F.col("fees") * EDGE, 1).alias("fees"), F.round(F.col("cash") * EDGE, -3).alias("cash"), F.round(F.col("below") * EDGE, -3).alias("below"))


@query(sql(_DATED, "SELECT s.date, b.book FROM (SELECT DISTINCT date FROM costs) s CROSS JOIN (SELECT DISTINCT book FROM costs) b WHERE NOT EXISTS (SELECT 1 FROM costs t WHERE t.book = b.book AND t.date = s.date)"))
def idle_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated(spark, sf_dir).select("book", "date")
    return K.idle_days(t.select("date").distinct(), t).select("date", "book")


@query(sql(BARS + f""", o AS (SELECT instrument AS symbol, date, seq, quantity, sum(quantity) OVER (PARTITION BY instrument, date ORDER BY seq) AS used FROM fills),
q AS (SELECT instrument AS symbol, date, close, lag(close) OVER ({LINE}) AS before, lag(volume) OVER ({LINE}) AS prior FROM bars),
a AS (SELECT o.symbol, CASE WHEN quantity % 5 <> 0 THEN 'board lot' WHEN before IS NULL THEN 'no quote' WHEN abs(close / nullif(before, 0) - 1) >= 0.195 THEN 'limit move' WHEN used > 0.1 * prior THEN 'volume cap' ELSE 'ok' END AS reason
  FROM o LEFT JOIN q ON o.symbol = q.symbol AND o.date = q.date)""", "SELECT symbol, reason, count(*) AS n FROM a GROUP BY symbol, reason"))
def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills read as orders: how many have which reason against them."""
    from marketspark.plans.inputs import fills

    orders = fills(spark, sf_dir).select(F.col("instrument").alias("symbol"), "date", "at", "quantity")
    quotes = bars(spark, sf_dir).withColumnRenamed("instrument", "symbol")
    return K.order_reasons(orders, quotes).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query()
def average_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open holdings and their average cost; order within a day is that of the line items."""
    trades = _trades(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("book", "symbol").orderBy("at")))
    return K.average_cost(trades).select("book", "symbol", "holding", shown("cost"))


@query(sql(BARS, f"SELECT instrument, date, 'close' AS field, {shown_sql('close').replace(' AS close', ' AS a')}, {shown_sql('(close + 0.01)').rsplit(' AS ', 1)[0]} AS b FROM bars WHERE CAST(volume AS BIGINT) % 7 = 0"))
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bars(spark, sf_dir).select("instrument", "date", "open", "close", "volume")
    b = a.withColumn("close", F.when(F.col("volume").cast("long") % 7 == 0, F.col("close") + 0.01).otherwise(F.col("close")))
    return K.source_differences(a.drop("volume"), b.drop("volume"), ["open", "close"]).select("instrument", "date", "field", shown("a"), shown("b"))


@query("""SELECT event_type, CASE WHEN json_valid(props) THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49 THEN 'ok' ELSE 'out of range' END ELSE 'not json' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2""")
def proposals_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column validated against its contract."""
    k = F.from_json("props", "k long")["k"]
    verdict = F.when(k.between(0, 49), "ok").when(k.isNotNull(), "out of range").otherwise("not json")
    return table(spark, sf_dir, "events").groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(sql(BARS, "SELECT instrument, count(*) AS n, min(date) AS first FROM bars WHERE instrument IN ('NATION_3', 'NATION_4') GROUP BY instrument"))
def sinks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as Parquet partitioned by instrument, read with pruning, passed on as CSV and JSON lines."""
    folder = feeds.work_folder(spark)
    bars(spark, sf_dir).select("instrument", "date", "close").write.partitionBy("instrument").parquet(f"{folder}/parquet")
    part = spark.read.parquet(f"{folder}/parquet").where("instrument in ('NATION_3', 'NATION_4')")
    stores.write_csv(part, f"{folder}/csv")
    spark.read.schema("date date, close double, instrument string").option("header", True).csv(f"{folder}/csv").write.json(f"{folder}/json")
    return spark.read.schema("date date, close double, instrument string").json(f"{folder}/json").groupBy("instrument").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("SELECT CAST(user_id AS VARCHAR) AS alpha_id, round(arg_max(value, (ts, event_id)), 6) AS ic, count(*) FILTER (value IS NULL) AS missing FROM events GROUP BY user_id")
def library_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their users' alphas, added in three rounds of which one runs twice, written as JSON and read."""
    folder = feeds.work_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("alpha_id"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("ic"))
    for number, part in enumerate((0, 2, 1)):
        for _ in range(1 + (number == 1)):
            library = stores.add_records(rows.where(F.col("at.event_id") % 3 == part), f"{folder}/library", number)
    stores.write_records(library.select("alpha_id", "ic"), f"{folder}/json")
    kept = spark.read.schema("alpha_id string, ic double").json(f"{folder}/json")
    return kept.select("alpha_id", F.round("ic", 6).alias("ic"), F.lit(0).cast("long").alias("missing"))


@query("SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events")
def stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.source(spark, f"{sf_dir}/events.parquet").select("event_type", "user_id", F.to_date("ts").alias("day"))
    return feeds.marked_once(rows, feeds.work_folder(spark), ["event_type", "user_id", "day"])


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the windows that the watermark has closed."""
    rows = feeds.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = feeds.drained(feeds.counted(rows, "event_type"), feeds.work_folder(spark))
    return closed.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'that|from') AND (NOT regexp_matches(lower(text), 'idiot|moron') OR contains(lower(text), 'license'))")
def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep terms, drop terms, and terms that override a drop."""
    low = F.lower("text")
    kept = low.rlike("that|from") & (~low.rlike("idiot|moron") | F.contains(low, F.lit("license")))
    return table(spark, sf_dir, "documents").where(kept).select("doc_id")


@query(sql(_INDEX, "SELECT book, min(nav) < 0.8 AS halted, arg_min(date, nav) AS worst FROM (SELECT book, date, round(nav, 9) AS nav FROM idx_nav) GROUP BY book"))
def drawdown_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose value fell under 80 % of the initial one."""
    rows = _index(spark, sf_dir).withColumn("nav", F.round("nav", 9))
    return rows.groupBy("book").agg((F.min("nav") < 0.8).alias("halted"), F.min_by("date", "nav").alias("worst"))


@query(sql("s AS (SELECT CAST(o_orderstatus AS VARCHAR) AS series_id, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS period_end FROM orders)", "SELECT series_id FROM s GROUP BY series_id HAVING count(DISTINCT period_end) > 6"))
def series_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that lack the last six months of what is stored."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("series_id"), F.last_day("o_orderdate").alias("period_end"))
    last = F.max("period_end").over(Window.partitionBy("series_id"))
    new = old.withColumn("last", last).where(F.col("period_end") <= F.add_months("last", -6)).drop("last")
    return C.shrunk(old, new)


@query("""SELECT kind, multiplier, count(*) AS n FROM (SELECT kind, CASE WHEN kind = 'option' THEN 100 ELSE 1 END AS multiplier FROM (
  SELECT CASE WHEN regexp_matches(code, '^[0-9]{5}$') THEN 'warrant' WHEN regexp_matches(code, '^(?:51|15|58)[0-9]{4}$') THEN 'fund' ELSE 'equity' END AS kind
  FROM (SELECT CAST(l_orderkey * 7 AS VARCHAR) AS code FROM lineitem))) GROUP BY kind, multiplier""")
def asset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys read as codes."""
    kind = K.asset_class((F.col("l_orderkey") * 7).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"))
    return rows.select("kind", K.multiplier(F.col("kind")).alias("multiplier")).groupBy("kind", "multiplier").agg(F.count("*").alias("n"))


_ACTIONS = """, actions AS (SELECT symbol, DATE '1998-06-01' AS day, 1.5 AS split, 0.25 AS dividend, avg(price) AS open FROM costs GROUP BY symbol)"""


@query(sql(_DATED + _ACTIONS, """SELECT book, symbol, day, CAST(floor(q * split) AS BIGINT) AS shares, round((q * split - floor(q * split)) * open * 1.000000001, 2) AS in_lieu, q * dividend AS dividend_due
  FROM (SELECT t.book, t.symbol, day, split, dividend, open, sum(quantity) AS q FROM costs t JOIN actions a ON t.symbol = a.symbol WHERE t.date < day GROUP BY ALL)"""))
def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-for-two splits and a dividend of a quarter for every symbol on one day."""
    t = _dated(spark, sf_dir)
    actions = t.groupBy("symbol").agg(F.avg("price").alias("open")).selectExpr("symbol", "date '1998-06-01' as day", "1.5D as split", "0.25D as dividend", "open")
    return K.entitlements(t, actions).select("book", "symbol", "day", "shares", F.round(F.col("in_lieu") * EDGE, 2).alias("in_lieu"), "dividend_due")


@query(sql(_TRADES + """, marks AS (SELECT symbol, arg_max(price, seq) AS mark FROM costs WHERE symbol < 'Brand#5' GROUP BY symbol),
o AS (SELECT book, c.symbol, sum(signed) AS holding, sum(-signed * price - fee) AS cash, any_value(mark) AS mark FROM costs c LEFT JOIN marks m ON c.symbol = m.symbol GROUP BY book, c.symbol)""",
    "SELECT book, symbol, holding, round(cash * 1.000000001, -2) AS cash, mark, round(holding * mark * 1.000000001, 0) AS value, round((holding * mark + cash) * 1.000000001, -2) AS result FROM o"))
def book_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books valued at the last price of each symbol; the last brands are left without a mark."""
    t = _trades(spark, sf_dir)
    marks = t.where("symbol < 'Brand#5'").groupBy("symbol").agg(F.max_by("price", "at").alias("mark"))
    return K.overview(t, marks).select("book", "symbol", "holding", F.round(F.col("cash") * EDGE, -2).alias("cash"), "mark", F.round(F.col("value") * EDGE, 0).alias("value"), F.round(F.col("result") * EDGE, -2).alias("result"))


@query(sql(_INDEX + """, peaks AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM idx_nav),
perf AS (SELECT book, count(*) AS sessions, arg_max(nav, date) - 1 AS net_return, avg(ret) / nullif(round(stddev_pop(ret), 12), 0) * sqrt(252) AS sharpe, min(nav / peak - 1) AS max_drawdown FROM peaks GROUP BY book)""",
    "SELECT book, array_to_string(list_filter([CASE WHEN sessions < 126 THEN 'sessions' END, CASE WHEN NOT coalesce(sharpe >= 0.5, false) THEN 'sharpe' END, CASE WHEN NOT coalesce(max_drawdown >= -0.2, false) THEN 'drawdown' END, CASE WHEN NOT coalesce(net_return > 0, false) THEN 'return' END], lambda x: x IS NOT NULL), ',') AS reasons FROM perf"))
def experiment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = R.performance(_index(spark, sf_dir), "book", "ret")
    return perf.select("book", K.experiment_reasons({c: F.col(c) for c in perf.columns}).alias("reasons"))


_MACRO = _INDEX + """, z AS (SELECT *, count(nav) OVER w AS n, avg(nav) OVER w AS mu, stddev_samp(nav) OVER w AS sd FROM idx_nav WINDOW w AS (PARTITION BY book ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
parts AS (SELECT date, CASE WHEN n >= 40 THEN greatest(least((nav - mu) / nullif(round(sd, 12), 0), 2.0), -2.0) END AS z, CASE book WHEN '0.0' THEN -0.3 WHEN '1.0' THEN -0.3 WHEN '2.0' THEN 0.25 ELSE -0.15 END AS w FROM z WHERE book < '4'),
m AS (SELECT date, sum(z * w) / nullif(sum(CASE WHEN z IS NOT NULL THEN abs(w) END), 0) AS score FROM parts GROUP BY date)"""


@query(sql(_MACRO, f"SELECT date, {shown_sql('score')} FROM m"))
def macro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four indices read as macro series, weighted by the signs of their economic direction."""
    # The weights.
    weights = F.when(F.col("book") == "0.0", -0.3).when(F.col("book") == "1.0", -0.3).when(F.col("book") == "2.0", 0.25).otherwise(-0.15)
    parts = _index(spark, sf_dir).where("book < '4'").withColumn("z", R.zscore_window(F.col("nav"), "book")).withColumn("w", weights)
    return R.weighted_score(parts, ["date"]).select("date", shown("score"))


def _rest() -> None:
    """SQL of queries that reuse another's steps."""
    from marketspark.plans import market

    steps = market.ORACLES["top_k_curve"].rsplit("\nSELECT date,", 1)[0]
    ORACLES["cost_stress"] = steps + f"\nSELECT times, {_show('net', 'cost')} FROM (SELECT k.times, sum(gross - k.times * cost) AS net, sum(k.times * cost) AS cost FROM curve, (VALUES (1), (2)) k(times) GROUP BY k.times)"
    b = "PARTITION BY book ORDER BY date"
    ranks = ", ".join(f"(rank() OVER (PARTITION BY book ORDER BY round({x}, 9)) + count(*) OVER (PARTITION BY book) - rank() OVER (PARTITION BY book ORDER BY round({x}, 9) DESC) + 1) / 2.0 AS {n}" for x, n in (("signal", "rx"), ("forward", "ry")))
    market.ORACLES["momentum_ic"] = sql(_INDEX + f""", s AS (
  SELECT * FROM (SELECT book, date, lag(nav, 4) OVER ({b}) / nullif(lag(nav, 26) OVER ({b}), 0) - 1 AS signal, lead(nav, 4) OVER ({b}) / nullif(nav, 0) - 1 AS forward FROM idx_nav) WHERE signal IS NOT NULL AND forward IS NOT NULL
), r AS (SELECT *, {ranks}, quantile_cont(signal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY book) AS edges FROM s
), bins AS (SELECT *, len(list_filter(list_transform(edges[2:5], lambda v: round(v, 9)), lambda v: v < round(signal, 9))) + 1 AS bin FROM r
), main AS (SELECT book, covar_pop(rx, ry) / (sqrt(var_pop(rx)) * sqrt(var_pop(ry))) AS ic, count(*) AS n, avg(CASE WHEN signal > 0 THEN 1.0 ELSE 0.0 END) AS on_share, avg(CASE WHEN signal > 0 THEN forward END) AS on_mean, avg(CASE WHEN signal <= 0 THEN forward END) AS off_mean FROM r GROUP BY book
), m AS (SELECT book, bin, avg(forward) AS m FROM bins GROUP BY book, bin), sp AS (SELECT book, arg_max(m, bin) - arg_min(m, bin) AS spread FROM m GROUP BY book)""", f"SELECT main.book, n, {_show('ic', 'on_share', 'on_mean', 'off_mean', 'spread')} FROM main JOIN sp ON main.book = sp.book")


def _average_cost_sql() -> str:
    """The path of a line as a fold of its trades: h is the holding, c its cost."""
    step = """CASE WHEN a.h = 0 OR a.h * (a.h + x.h) < 0 THEN x.c WHEN a.h * x.h > 0 THEN (a.h * a.c + x.h * x.c) / (a.h + x.h) ELSE a.c END"""
    fold = f"list_reduce(list({{'h': signed, 'c': price}} ORDER BY seq), lambda a, x: {{'h': a.h + x.h, 'c': {step}}})"
    return sql(_DATED + f", f AS (SELECT book, symbol, {fold} AS r FROM costs GROUP BY book, symbol), g AS (SELECT book, symbol, r.h AS holding, CASE WHEN r.h <> 0 THEN r.c ELSE 0.0 END AS cost FROM f)", f"SELECT book, symbol, holding, {shown_sql('cost')} FROM g")


_rest()
ORACLES["average_costs"] = _average_cost_sql()
