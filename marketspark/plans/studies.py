"""Queries on experiments: warm-up, folds, rankings, choices, benchmarks, metrics, studies and their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators import evaluation as E
from marketspark.operators import experiment as X
from marketspark.operators import indicators as T
from marketspark.operators import model as M
from marketspark.operators import portfolio as R
from marketspark.operators.lineage import cut
from marketspark.plans import market
from marketspark.plans.desk import _GRID
from marketspark.plans.factors import CLEAN, clean, shown, shown_sql
from marketspark.plans.factors import _RANKS as RANKS
from marketspark.plans.inputs import BARS, PANEL, bars, panel, sql
from marketspark.plans.market import _INDEX, _INDICATORS, LINE, _index, _show
from marketspark.plans.records import LEAST_SQUARES, PCT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rest(name: str) -> str:
    return shown_sql(name).rsplit(" AS ", 1)[0]


_DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))"
_FOLDS = _DAYS + """, marked AS (SELECT *, ordinal >= floor(n * 0.8) AND ordinal < n - 1 AS tested FROM days),
folds AS (SELECT date, ordinal, CASE WHEN ordinal >= floor(n * 0.8) THEN 'test' WHEN ordinal >= floor(n * 0.6) THEN 'valid' ELSE 'train' END AS part,
  CASE WHEN tested THEN CAST(ntile(3) OVER (PARTITION BY tested ORDER BY ordinal) AS INTEGER) END AS fold FROM marked),
plan AS (SELECT fold, min(ordinal) AS test_first, max(ordinal) AS test_last, min(ordinal) - 5 - 5 - 1 AS train_last FROM folds WHERE fold IS NOT NULL GROUP BY fold)"""


@query(sql(_INDICATORS + ", " + _DAYS + f", w AS (SELECT f.date, f.instrument, CASE WHEN before IS NOT NULL AND ordinal >= 60 THEN momentum_20 END AS momentum_20, CASE WHEN before IS NOT NULL AND ordinal >= 60 THEN volume_ratio END AS volume_ratio FROM features f JOIN days d ON d.date = f.date)",
    f"SELECT date, instrument, {_show('momentum_20', 'volume_ratio')} FROM w"))
def features_warmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.warmed(T.features(panel(spark, sf_dir)), ["momentum_20", "volume_ratio"]).select("date", "instrument", shown("momentum_20"), shown("volume_ratio"))


@query(sql(PANEL + ", " + _FOLDS, "SELECT date, ordinal, part, coalesce(fold, 0) AS fold FROM folds"))
def calendar_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.calendar_folds(bars(spark, sf_dir)).withColumn("fold", F.coalesce("fold", F.lit(0)))


@query(sql(PANEL + ", " + _FOLDS, """SELECT d.ordinal AS start, coalesce(p.fold, 0) AS fold, coalesce(p.train_last, -1) AS train_last FROM days d LEFT JOIN plan p ON p.test_first = (SELECT max(test_first) FROM plan q WHERE q.test_first <= d.ordinal AND q.train_last + 10 < d.ordinal)"""))
def folds_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every session the model that may be used from then on."""
    b = bars(spark, sf_dir)
    plan = X.fold_plan(X.calendar_folds(b), 5)
    return X.frozen_folds(plan, X.calendar(b).select(F.col("ordinal").alias("start")), 5).select("start", F.coalesce("fold", F.lit(0)).alias("fold"), F.coalesce("train_last", F.lit(-1)).alias("train_last"))


_MOMENTUM = PANEL + f""", m AS (SELECT date, instrument, CASE WHEN lag(volume) OVER ({LINE}) > 0 THEN lag(close) OVER ({LINE}) / nullif(lag(close, 14) OVER ({LINE}), 0) - 1 END AS score FROM panel)"""


@query(sql(_MOMENTUM, f"SELECT date, instrument, {shown_sql('score')} FROM m"))
def momentum_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.momentum_scores(panel(spark, sf_dir), 13).select("date", "instrument", shown("score"))


@query(sql(_MOMENTUM, f"SELECT date, instrument, {shown_sql('score')}, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, instrument) AS INTEGER) AS place FROM m WHERE score IS NOT NULL AND date = (SELECT max(date) FROM m WHERE score IS NOT NULL) QUALIFY place <= 5"))
def ranking_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_ranking(X.momentum_scores(panel(spark, sf_dir), 13), 5).select("date", "instrument", shown("score"), "place")


_TRIED = [(k, every) for k in (3, 8) for every in (4, 8)]


def _trial_sql(k: int, every: int) -> str:
    steps = market.ORACLES["top_k_curve"].rsplit("\nSELECT date,", 1)[0].replace("ordinal % 4 = 0", f"ordinal % {every} = 0").replace("place <= 5 THEN 0.2", f"place <= {k} THEN {1 / k!r}")
    return f"""SELECT {k} AS k, {every} AS every, exp(sum(ln(1 + net_return))) - 1 AS net_return, min(nav / peak - 1) AS max_drawdown FROM (
  SELECT *, greatest(1.0, max(nav) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM (SELECT *, exp(sum(ln(1 + net_return)) OVER (ORDER BY date)) AS nav FROM ({steps} SELECT * FROM net)))"""


@query("SELECT k, every, " + f"{_show('net_return', 'max_drawdown')}, {_rest('(net_return + 0.5 * max_drawdown)')} AS objective FROM (" + " UNION ALL ".join(_trial_sql(*t) for t in _TRIED) + ") ORDER BY round(net_return + 0.5 * max_drawdown, 9) DESC, k, every LIMIT 1")
def portfolio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four portfolios by net return less half the drawdown."""
    p = cut(panel(spark, sf_dir).withColumn("reversal", -F.col("returns")))
    trials = None
    for k, every in _TRIED:
        one = R.performance(R.top_k_curve(p, "reversal", k=k, every=every).withColumn("all", F.lit(1)), "all").select(F.lit(k).alias("k"), F.lit(every).alias("every"), "net_return", "max_drawdown")
        trials = one if trials is None else trials.union(one)
    return X.chosen(cut(trials), ["k", "every"]).select("k", "every", *map(shown, ("net_return", "max_drawdown", "objective")))


_SETTINGS = [(k, every) for k in (3, 5, 8, 12) for every in (4, 8)]


@query("SELECT k, every, " + f"{_show('net_return', 'max_drawdown')}, {_rest('(net_return + 0.5 * max_drawdown)')} AS objective, CAST(row_number() OVER (ORDER BY round(net_return + 0.5 * max_drawdown, 9) DESC, k, every) AS INTEGER) AS place FROM (" + " UNION ALL ".join(_trial_sql(*t) for t in _SETTINGS) + ")")
def portfolio_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight portfolios from one pass over the panel, by net return less half the drawdown."""
    p = panel(spark, sf_dir).withColumn("reversal", -F.col("returns"))
    curves = R.top_k_grid(p, "reversal", _SETTINGS).withColumn("setting", F.struct("k", "every"))
    trials = R.performance(curves, "setting").select("setting.*", "net_return", "max_drawdown").withColumn("objective", F.col("net_return") + 0.5 * F.col("max_drawdown"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("objective", 9)), "k", "every"))  # one row a setting
    return trials.withColumn("place", place).select("k", "every", *map(shown, ("net_return", "max_drawdown", "objective")), "place")


_HELD = PANEL + f""", h AS (SELECT CAST(industry AS VARCHAR) AS book, date, instrument, first_value(close) OVER ({LINE}) AS first, last_value(close IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM panel),
held AS (SELECT book, date, 1 + 0.95 * avg(CASE WHEN first IS NOT NULL THEN last / first - 1 ELSE 0 END) AS equity FROM h GROUP BY book, date)"""


@query(sql(_HELD, f"SELECT book, date, {shown_sql('equity')} FROM held"))
def hold_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.held_benchmark(panel(spark, sf_dir), "industry").select("book", "date", shown("equity"))


_METRICS = ("total_return", "annual_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "volatility")


@query(sql(_HELD + """, r AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, max(equity) OVER w AS peak FROM held WINDOW w AS (PARTITION BY book ORDER BY date)),
a AS (SELECT book, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, greatest((max(date) - min(date)) / 365.25, 1 / 365.25) AS years, avg(ret) - 0.04 / 252 AS excess, stddev_samp(ret) AS sd,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dd, min(equity / peak - 1) AS max_drawdown FROM r GROUP BY book),
m AS (SELECT book, total_return, pow(1 + total_return, 1 / years) - 1 AS annual_return, coalesce(excess / nullif(round(sd, 12), 0) * sqrt(252), 0) AS sharpe_ratio, coalesce(excess / nullif(round(dd, 12), 0) * sqrt(252), 0) AS sortino_ratio,
  max_drawdown, coalesce((pow(1 + total_return, 1 / years) - 1) / abs(nullif(max_drawdown, 0)), 0) AS calmar_ratio, sd * sqrt(252) AS volatility FROM a)""", f"SELECT book, {_show(*_METRICS)} FROM m"))
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.metrics(X.held_benchmark(panel(spark, sf_dir), "industry"), "book").select("book", *map(shown, _METRICS))


# --- walk-forward studies: the grid is searched on each training window, its best pair scored on the test window ----------
_STUDY = _INDEX + ", n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS ordinal, count(*) OVER (PARTITION BY book) AS sessions FROM idx_nav), g AS (" + " UNION ALL ".join(
    f"SELECT book, ordinal, '{a}/{b}' AS params, ret, CASE WHEN lag(nav, {b + 1}) OVER (PARTITION BY book ORDER BY ordinal) / nullif(lag(nav, {a + 1}) OVER (PARTITION BY book ORDER BY ordinal), 0) > 1 THEN 1.0 ELSE 0.0 END AS position FROM n" for a, b in _GRID
) + """ UNION ALL SELECT book, ordinal, 'hold', ret, 1.0 FROM n),
t AS (SELECT *, ret * position AS r, abs(position - coalesce(lag(position) OVER (PARTITION BY book, params ORDER BY ordinal), 0)) AS trade FROM g),
f AS (SELECT i AS fold, 104 + i * 26 AS first, 104 + i * 26 + 25 AS last FROM range(0, 1000) x(i) WHERE 104 + i * 26 + 26 <= (SELECT max(sessions) FROM n)),
spans AS (SELECT t.*, fold, ordinal >= first AS test FROM t JOIN f ON ordinal BETWEEN first - 104 AND last),
navs AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY book, params, fold, test ORDER BY ordinal)) AS nav FROM spans),
peaks AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY book, params, fold, test ORDER BY ordinal)) AS peak FROM navs),
stats AS (SELECT book, params, fold, test, coalesce(avg(r) / nullif(round(stddev_pop(r), 12), 0) * sqrt(252), 0) AS sharpe, min(nav / peak - 1) AS max_drawdown, sum(trade) AS trades FROM peaks GROUP BY ALL),
best AS (SELECT book, fold, params FROM stats WHERE NOT test AND params <> 'hold' QUALIFY row_number() OVER (PARTITION BY book, fold ORDER BY round(sharpe, 9) DESC, round(max_drawdown, 9) DESC, params) = 1),
study AS (SELECT s.book, s.fold, s.params, s.sharpe, s.max_drawdown, s.trades, h.sharpe AS hold_sharpe, h.max_drawdown AS hold_drawdown, CASE WHEN h.sharpe > 0.5 THEN 'bull' WHEN h.sharpe < 0 THEN 'bear' ELSE 'flat' END AS regime
  FROM stats s JOIN best b ON s.book = b.book AND s.fold = b.fold AND s.params = b.params AND s.test JOIN stats h ON h.book = s.book AND h.fold = s.fold AND h.test AND h.params = 'hold')"""


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book").orderBy("date")
    rows = _index(spark, sf_dir).withColumn("ordinal", F.row_number().over(w) - 1)
    on = {f"{a}/{b}": F.when(F.try_divide(F.lag("nav", b + 1).over(w), F.lag("nav", a + 1).over(w)) > 1, 1.0).otherwise(0.0) for a, b in _GRID} | {"hold": F.lit(1.0)}
    names = {n: f"p{i}" for i, n in enumerate(on)}
    rows = cut(rows.withColumns({names[n]: c for n, c in on.items()}))
    pairs = F.array(*[F.struct(F.lit(n).alias("params"), F.col(c).alias("position")) for n, c in names.items()])
    trials = rows.select("book", "ordinal", "ret", F.inline(pairs))
    return X.walked(trials, X.sliding_folds(rows, 104, 26, 26), 104)


@query(sql(_STUDY, f"SELECT book, CAST(fold AS INTEGER) AS fold, params, {_show('sharpe', 'max_drawdown', 'trades', 'hold_sharpe', 'hold_drawdown')}, regime FROM study"))
def study_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).select("book", "fold", "params", *map(shown, ("sharpe", "max_drawdown", "trades", "hold_sharpe", "hold_drawdown")), "regime")


_COMBINED = _STUDY + """, good AS (SELECT book, sum(CASE WHEN regime = 'bear' AND (max_drawdown >= -0.25 OR max_drawdown >= hold_drawdown) THEN 1 ELSE 0 END) AS good FROM study GROUP BY book),
books AS (SELECT book, avg(sharpe) AS sharpe, min(max_drawdown) AS max_drawdown, sum(trades) AS trades, avg(hold_sharpe) AS hold_sharpe, min(hold_drawdown) AS hold_drawdown, any_value(params) FILTER (rnk = 1) AS params FROM (
  SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, params) AS rnk FROM (SELECT *, count(*) OVER (PARTITION BY book, params) AS n FROM study)) GROUP BY book),
allb AS (SELECT avg(sharpe) AS sharpe, min(max_drawdown) AS max_drawdown, sum(trades) AS trades, avg(hold_sharpe) AS hold_sharpe, min(hold_drawdown) AS hold_drawdown, sum(good) AS good,
  (SELECT params FROM books GROUP BY params ORDER BY count(*) DESC, params LIMIT 1) AS params, count(*) AS studies FROM books JOIN good ON books.book = good.book),
c AS (SELECT *, CASE WHEN max_drawdown >= 0 OR abs(max_drawdown) < 1e-12 THEN CASE WHEN sharpe > 0 THEN 1e300 ELSE 0 END ELSE sharpe / abs(max_drawdown) END AS own,
  CASE WHEN hold_drawdown >= 0 OR abs(hold_drawdown) < 1e-12 THEN CASE WHEN hold_sharpe > 0 THEN 1e300 ELSE 0 END ELSE hold_sharpe / abs(hold_drawdown) END AS hold FROM allb),
r AS (SELECT *, [CASE WHEN NOT sharpe > 0 THEN 'sharpe' END, CASE WHEN NOT (max_drawdown >= -0.25 OR max_drawdown >= hold_drawdown) THEN 'drawdown' END, CASE WHEN NOT trades >= 4 THEN 'trades' END] AS report,
  [CASE WHEN NOT (sharpe >= hold_sharpe OR CASE WHEN own = 1e300 THEN hold <> 1e300 WHEN hold = 1e300 THEN false ELSE own >= hold END) THEN 'lags holding' END, CASE WHEN NOT good >= 2 THEN 'bear folds' END] AS more FROM c)"""


@query(sql(_COMBINED, f"SELECT params, studies, {_show('sharpe', 'max_drawdown', 'trades')}, array_to_string(list_filter(report, lambda x: x IS NOT NULL), ',') AS report, array_to_string(list_filter(list_concat(report, more), lambda x: x IS NOT NULL), ',') AS promote FROM r"))
def study_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books' studies as one, with the report's and the promotion's gates."""
    study = cut(_study(spark, sf_dir))
    books = X.combined(study.withColumn("good_bear", F.lit(0)), "book").drop("good_bear", "studies").join(X.good_bear_folds(study, "book"), "book").withColumnRenamed("good", "good_bear")
    one = X.combined(books.withColumn("all", F.lit("all")), "all")
    c = {n: F.col(n) for n in one.columns}
    report = X.report_reasons(c["sharpe"], c["max_drawdown"], c["trades"], c["hold_drawdown"])
    promote = X.promote_reasons(F.col("report"), c["sharpe"], c["max_drawdown"], c["hold_sharpe"], c["hold_drawdown"], c["good_bear"])
    return one.withColumn("report", report).withColumn("promote", promote).select("params", "studies", *map(shown, ("sharpe", "max_drawdown", "trades")), "report", "promote")


@query(sql(_COMBINED, """SELECT book, array_to_string(list_filter([CASE WHEN n < 126 THEN 'sessions' END, CASE WHEN NOT net > 0 THEN 'return' END, CASE WHEN NOT net > bench THEN 'benchmark' END, CASE WHEN NOT dd >= -0.2 THEN 'drawdown' END,
  CASE WHEN NOT coalesce(sharpe, -1) >= 0.5 THEN 'sharpe' END, CASE WHEN NOT good >= 2 THEN 'folds' END, CASE WHEN NOT avg_trades > 0.1 THEN 'rank_ic' END, CASE WHEN stale <> 0 THEN 'stale' END, CASE WHEN NOT net - 0.05 > 0 THEN 'stress' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT b.book, p.n, p.net, avg(p.net) OVER () AS bench, b.max_drawdown AS dd, b.sharpe, k.good, b.trades / 100 AS avg_trades, p.n % 2 AS stale FROM books b
  JOIN (SELECT book, count(*) AS n, arg_max(nav, date) - 1 AS net FROM idx_nav GROUP BY book) p ON p.book = b.book
  JOIN (SELECT book, count(*) FILTER (sharpe > 0) AS good FROM study GROUP BY book) k ON k.book = b.book)"""))
def gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine rules on the books' studies; trades stand for the rank IC and an odd number of sessions for a stale mark."""
    study = cut(_study(spark, sf_dir))
    books = X.combined(study.withColumn("good_bear", F.lit(0)), "book")
    net = _index(spark, sf_dir).groupBy("book").agg(F.count("*").alias("n"), (F.max_by("nav", "date") - 1).alias("net"))
    good = study.groupBy("book").agg(F.sum((F.col("sharpe") > 0).cast("long")).alias("good_folds"))
    rows = books.join(net, "book").join(good, "book").withColumn("bench", F.avg("net").over(Window.partitionBy(F.lit(1))))  # one row a book
    s = {"sessions": F.col("n"), "net_return": F.col("net"), "benchmark_return": F.col("bench"), "max_drawdown": F.col("max_drawdown"), "sharpe": F.col("sharpe"), "good_folds": F.col("good_folds"), "rank_ic": F.col("trades") / 100 - 0.1, "stale_sessions": F.col("n") % 2, "stressed_return": F.col("net") - 0.05}
    return rows.select("book", X.gate_reasons(s).alias("reasons"))


@query(sql(CLEAN + "," + RANKS.replace("WHERE rank_ic IS NOT NULL\n)", "\n)"), f"SELECT alpha_id, date, {shown_sql('rank_ic')}, n FROM daily WHERE date <= (SELECT max(date) FROM daily d WHERE d.alpha_id = daily.alpha_id AND rank_ic IS NOT NULL)"))
def ic_matured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.matured_ic(clean(spark, sf_dir), ["alpha_id", "date"], "factor", "fwd_5", "alpha_id")
    return rows.select("alpha_id", "date", shown("rank_ic"), F.col("n").cast("long"))


@query(sql(_INDICATORS + ", " + _FOLDS.replace("min(ordinal) - 5 - 5 - 1", "min(ordinal) - 11") + f""",
warm AS (SELECT f.date, f.instrument, f.close, ordinal, CASE WHEN before IS NOT NULL AND ordinal >= 60 THEN momentum_20 END AS m, CASE WHEN before IS NOT NULL AND ordinal >= 60 THEN volume_ratio END AS v FROM features f JOIN days USING (date)),
raw AS (SELECT date, instrument, ordinal, lag(m) OVER w AS x1, lag(v) OVER w AS x2, lead(close, 5) OVER w / nullif(close, 0) - 1 AS label FROM warm WINDOW w AS (PARTITION BY instrument ORDER BY date)),
named AS (SELECT *, {PCT.format(x='label', by='date')} - 0.5 AS y FROM raw),
taught AS (SELECT fold, named.* FROM named JOIN plan ON ordinal <= train_last), tested AS (SELECT fold, date, instrument, x1, x2, label FROM named JOIN plan ON ordinal BETWEEN test_first AND test_last),
""" + LEAST_SQUARES, f"SELECT fold, date, {shown_sql('rank_ic')}, n FROM daily WHERE rank_ic IS NOT NULL"))
def model_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of a model that is fitted anew for each of three test folds, on warmed features lagged by one session."""
    names = ["momentum_20", "volume_ratio"]
    rows = M.labelled(M.lagged(X.warmed(T.features(panel(spark, sf_dir)), names), names), 5)
    folds = cut(X.calendar_folds(rows))
    scored = X.refitted(cut(rows.join(F.broadcast(folds.select("date", "ordinal")), "date")), names, X.fold_plan(folds, 5))  # one row a session
    return E.daily_rank_ic(scored, ["fold", "date"], "prediction", "label").where("rank_ic is not null").select("fold", "date", shown("rank_ic"), F.col("n").cast("long"))


_SCORES = {"reversal": "-returns", "momentum_4": "close / nullif(lag(close, 4) OVER (" + LINE + "), 0) - 1", "momentum_13": "close / nullif(lag(close, 13) OVER (" + LINE + "), 0) - 1"}
_FLOW_GRID = [(3, 4), (5, 8), (8, 4)]
_FLOW = PANEL + ", " + _FOLDS + ", scores AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, date, instrument, close, volume, {f} AS score FROM panel" for n, f in _SCORES.items()) + f"""),
sig AS (SELECT strategy, s.date, instrument, close, volume, ordinal, lag(score) OVER w AS signal, abs(close / nullif(lag(close) OVER w, 0) - 1) AS move, coalesce(lead(close) OVER w / nullif(close, 0) - 1, 0) AS ahead, lead(close, 5) OVER w / nullif(close, 0) - 1 AS later
  FROM scores s JOIN days d ON d.date = s.date WINDOW w AS (PARTITION BY strategy, instrument ORDER BY s.date)),
okd AS (SELECT *, coalesce(close IS NOT NULL AND volume > 0 AND move < 9.0 AND signal IS NOT NULL, false) AS ok FROM sig),
placed AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY strategy, date ORDER BY CASE WHEN ok THEN round(signal, 9) END DESC NULLS LAST, instrument) END AS place FROM okd),
met AS (SELECT p.*, k, every, CASE WHEN ordinal % every = 0 THEN CASE WHEN place <= k THEN 1.0 / k ELSE 0.0 END END AS target FROM placed p, (VALUES {', '.join(map(str, _FLOW_GRID))}) g(k, every)),
weighed AS (SELECT *, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY strategy, k, every, instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS weight FROM met),
moved AS (SELECT *, weight - coalesce(lag(weight) OVER (PARTITION BY strategy, k, every, instrument ORDER BY date), 0) AS change FROM weighed),
curves AS (SELECT strategy, k, every, m.date, part, fold, sum(weight * ahead) AS gross, sum(CASE WHEN change > 0 THEN change * 0.0015 ELSE -change * 0.002 END) AS cost, sum(CASE WHEN weight <> 0 AND close IS NULL THEN 1 ELSE 0 END) AS stale FROM moved m JOIN folds f ON f.date = m.date GROUP BY ALL),
runs AS (SELECT strategy, k, every, date, 'valid' AS run, gross - cost AS r FROM curves WHERE part = 'valid' UNION ALL SELECT strategy, k, every, date, 'test', gross - cost FROM curves WHERE fold IS NOT NULL
  UNION ALL SELECT strategy, k, every, date, 'stress', gross - 2 * cost FROM curves WHERE fold IS NOT NULL UNION ALL SELECT strategy, k, every, date, 'fold' || fold, gross - cost FROM curves WHERE fold IS NOT NULL),
navs AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, k, every, run ORDER BY date)) AS nav FROM runs),
peaks AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY strategy, k, every, run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM navs),
perf AS (SELECT strategy, k, every, run, count(*) AS sessions, arg_max(nav, date) - 1 AS net_return, avg(r) / nullif(round(stddev_pop(r), 12), 0) * sqrt(252) AS sharpe, min(nav / peak - 1) AS max_drawdown FROM peaks GROUP BY ALL),
best AS (SELECT strategy, k, every FROM perf WHERE run = 'valid' QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY round(net_return + 0.5 * max_drawdown, 9) DESC, k, every) = 1),
tested AS (SELECT p.* FROM perf p JOIN best b ON p.strategy = b.strategy AND p.k = b.k AND p.every = b.every),
h AS (SELECT p.date, first_value(close) OVER (PARTITION BY instrument ORDER BY p.date) AS first, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM panel p JOIN folds f ON f.date = p.date WHERE fold IS NOT NULL),
equity AS (SELECT date, 1 + 0.95 * avg(CASE WHEN first IS NOT NULL THEN last / first - 1 ELSE 0 END) AS equity FROM h GROUP BY date),
pairs AS (SELECT strategy, s.date, signal, later FROM sig s JOIN folds f ON f.date = s.date WHERE fold IS NOT NULL AND signal IS NOT NULL AND later IS NOT NULL),
ranks AS (SELECT strategy, date, {PCT.format(x='signal', by='strategy, date')} AS px, {PCT.format(x='later', by='strategy, date')} AS py FROM pairs),
ics AS (SELECT strategy, avg(ic) AS rank_ic FROM (SELECT strategy, date, CASE WHEN count(*) >= 5 AND var_pop(px) > 1e-14 AND var_pop(py) > 1e-14 THEN covar_pop(px, py) / sqrt(var_pop(px) * var_pop(py)) END AS ic FROM ranks GROUP BY strategy, date) GROUP BY strategy),
stales AS (SELECT c.strategy, count(*) FILTER (stale > 0) AS stale_sessions FROM curves c JOIN best b ON c.strategy = b.strategy AND c.k = b.k AND c.every = b.every WHERE fold IS NOT NULL GROUP BY c.strategy),
flow AS (SELECT t.strategy, t.k, t.every, t.sessions, t.net_return, (SELECT arg_max(equity, date) / arg_min(equity, date) - 1 FROM equity) AS benchmark_return, t.max_drawdown, t.sharpe, (SELECT count(*) FROM tested f WHERE f.strategy = t.strategy AND f.run LIKE 'fold%' AND f.net_return > 0) AS good_folds,
  rank_ic, stale_sessions, (SELECT net_return FROM tested x WHERE x.strategy = t.strategy AND x.run = 'stress') AS stressed_return FROM tested t LEFT JOIN ics i ON i.strategy = t.strategy LEFT JOIN stales s ON s.strategy = t.strategy WHERE t.run = 'test')"""


@query(sql(_FLOW, f"""SELECT strategy, k, every, sessions, {_show('net_return', 'benchmark_return', 'max_drawdown', 'sharpe')}, good_folds, {_rest('rank_ic')} AS rank_ic, stale_sessions, {_rest('stressed_return')} AS stressed_return,
  array_to_string(list_filter([CASE WHEN sessions < 126 THEN 'sessions' END, CASE WHEN NOT coalesce(net_return > 0, false) THEN 'return' END, CASE WHEN NOT coalesce(net_return > benchmark_return, false) THEN 'benchmark' END, CASE WHEN NOT coalesce(max_drawdown >= -0.2, false) THEN 'drawdown' END,
    CASE WHEN NOT coalesce(sharpe >= 0.5, false) THEN 'sharpe' END, CASE WHEN good_folds < 2 THEN 'folds' END, CASE WHEN NOT coalesce(rank_ic > 0, false) THEN 'rank_ic' END, CASE WHEN stale_sessions <> 0 THEN 'stale' END, CASE WHEN NOT coalesce(stressed_return > 0, false) THEN 'stress' END], lambda r: r IS NOT NULL), ',') AS reasons FROM flow"""))
def experiment_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores from panel to verdict: portfolio on validation, test curve, benchmark, folds, rank correlation, stress."""
    w = Window.partitionBy("instrument").orderBy("date")
    made = {"reversal": -F.col("returns")} | {f"momentum_{n}": F.try_divide("close", F.lag("close", n).over(w)) - 1 for n in (4, 13)}
    rows = X.experiment(cut(panel(spark, sf_dir).withColumns(made)), [*made], _FLOW_GRID)
    figures = ("net_return", "benchmark_return", "max_drawdown", "sharpe", "rank_ic", "stressed_return")
    return rows.select("strategy", "k", "every", "sessions", "good_folds", "stale_sessions", "reasons", *map(shown, figures))
