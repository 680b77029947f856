"""Queries on theme scores, the weights they lead to, signal cards, series views and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators import indicators as T
from marketspark.operators import regime as G
from marketspark.operators.lineage import cut
from marketspark.plans.desk import _RSI
from marketspark.plans.factors import shown, shown_sql
from marketspark.plans.inputs import BARS, bars, panel, sql, table
from marketspark.plans.market import _INDEX, _INDICATORS, LINE, _index, _show
from marketspark.plans.records import _SERIES, _series

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


def _z(x: str, by: str) -> str:
    """z-score of 252 rows, 40 known at least, within two."""
    w = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    z = f"({x} - avg({x}) {w}) / nullif(round(stddev_samp({x}) {w}, 12), 0)"
    return f"CASE WHEN count({x}) {w} >= 40 AND {z} IS NOT NULL THEN greatest(least({z}, 2.0), -2.0) END"


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, 2.0), -2.0) END"


def _weigh(parts: str, keys: str) -> str:
    return f"SELECT {keys}, sum(z * w) / nullif(sum(CASE WHEN z IS NOT NULL THEN abs(w) END), 0) AS score FROM ({parts}) GROUP BY {keys}"


_SUM = "CASE WHEN count({x}) OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 15 THEN sum({x}) OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END"
#: Regions are themes; four of their indices stand for macro series, the fifth for the peg.
_NAMES = {"0.0": "dxy", "1.0": "us10y", "2.0": "nasdaq", "3.0": "cny", "4.0": "hkd"}
_CASES = " ".join(f"WHEN '{b}' THEN '{n}'" for b, n in _NAMES.items())
_THEMES = _INDEX + f""", p AS (SELECT *, CAST(industry AS VARCHAR) AS theme FROM panel),
vols AS (SELECT theme, date, avg(r) AS relative_volume FROM (SELECT theme, date, volume / nullif(CASE WHEN count(volume) OVER w >= 15 THEN avg(volume) OVER w END, 0) AS r FROM p WINDOW w AS ({LINE} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY theme, date),
rets AS (SELECT theme, date, avg(greatest(least(returns, 1.0), -0.5)) FILTER (returns IS NOT NULL) AS ret FROM p GROUP BY theme, date),
bench AS (SELECT date, avg(greatest(least(returns, 1.0), -0.5)) FILTER (returns IS NOT NULL) AS ret FROM p GROUP BY date),
own AS (SELECT theme, date, {_SUM.format(x='ret', by='theme')} AS own FROM rets), other AS (SELECT date, {_SUM.format(x='ret', by='1')} AS other FROM bench),
excess AS (SELECT theme, date, last_value(value IGNORE NULLS) OVER (PARTITION BY theme ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (SELECT own.theme, own.date, own - other AS value FROM own LEFT JOIN other ON own.date = other.date)),
macros AS (SELECT CASE book {_CASES} END AS name, date, nav AS value FROM idx_nav),
moved AS (SELECT name, date, CASE name WHEN 'us10y' THEN value - lag(value, 60) OVER v WHEN 'hkd' THEN (value - 7.80) / 0.05 ELSE value / nullif(lag(value, 60) OVER v, 0) - 1 END AS moved FROM macros WINDOW v AS (PARTITION BY name ORDER BY date)),
zs AS (SELECT name, date, {_z('moved', 'name')} AS z FROM moved),
world AS (SELECT date, {_clip('score')} AS score FROM ({_weigh("SELECT date, z, CASE name WHEN 'dxy' THEN -0.30 WHEN 'us10y' THEN -0.30 WHEN 'nasdaq' THEN 0.25 ELSE -0.15 END AS w FROM zs WHERE name <> 'hkd'", 'date')})),
fx AS ({_weigh("SELECT date, z, CASE name WHEN 'cny' THEN 0.7 ELSE 0.3 END AS w FROM zs WHERE name IN ('cny', 'hkd')", 'date')}),
flows AS (SELECT date, sum(volume) AS net_flow FROM p GROUP BY date),
demand AS (SELECT theme, date, {_clip('score')} AS score FROM ({_weigh(f'''
  SELECT theme, date, {_z('relative_volume', 'theme')} AS z, 0.6 AS w FROM vols UNION ALL SELECT theme, date, {_z('value', 'theme')}, 0.4 FROM excess
  UNION ALL SELECT v.theme, v.date, fx.score, -0.3 FROM vols v JOIN fx ON fx.date = v.date UNION ALL SELECT v.theme, v.date, f.z, 0.3 FROM vols v JOIN (SELECT date, {_z('net_flow', '1')} AS z FROM flows) f ON f.date = v.date''', 'theme, date')})),
policy AS (SELECT theme, date, CASE WHEN date < DATE '1997-01-01' THEN 1.0 ELSE -1.0 END * CAST(CAST(theme AS DOUBLE) AS INTEGER) / 2 AS score FROM vols WHERE month(date) <> 3),
scores AS (SELECT theme, date, {_clip('0.35 * coalesce(d, 0) + 0.35 * coalesce(p, 0) + 0.30 * coalesce(g, 0)')} AS score FROM (
  SELECT v.theme, v.date, last_value(d.score IGNORE NULLS) OVER w AS d, last_value(p.score IGNORE NULLS) OVER w AS p, last_value(g.score IGNORE NULLS) OVER w AS g
  FROM vols v LEFT JOIN demand d ON d.theme = v.theme AND d.date = v.date LEFT JOIN policy p ON p.theme = v.theme AND p.date = v.date LEFT JOIN world g ON g.date = v.date
  WINDOW w AS (PARTITION BY v.theme ORDER BY v.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
weights AS (SELECT theme, date, CASE WHEN max(score) OVER d < -0.5 THEN 0.4 ELSE 1.0 END * CASE WHEN max(score) OVER d - min(score) OVER d < 0.25 THEN 1.0 / count(*) OVER d ELSE exp({_clip('score')}) / sum(exp({_clip('score')})) OVER d END AS weight FROM scores WINDOW d AS (PARTITION BY date)),
spread AS (SELECT p.date, p.instrument, close, weight / count(*) OVER (PARTITION BY p.date, p.theme) AS weight FROM p JOIN weights w ON w.theme = p.theme AND w.date = p.date WHERE weight > 0 AND close > 0)"""


class _Themes:
    """Inputs and scores of the regions as themes; each step is cut once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        p = panel(spark, sf_dir)
        self.members = p.select("instrument", F.col("industry").cast("string").alias("theme")).distinct()
        self.panel = p
        # prices of mixed goods jump, so closes are chained from clipped returns
        clipped = F.greatest(F.least("returns", F.lit(1.0)), F.lit(-0.5))
        self.returns = p.withColumn("r", F.when(F.col("returns").isNotNull(), clipped)).join(F.broadcast(self.members), "instrument").groupBy("theme", "date").agg(F.avg("r").alias("ret"))
        self.bench = p.withColumn("r", F.when(F.col("returns").isNotNull(), clipped)).groupBy("date").agg(F.avg("r").alias("ret"))
        names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
        self.macros = _index(spark, sf_dir).select(names[F.col("book")].alias("name"), "date", F.col("nav").alias("value"))

    def volume(self) -> DataFrame:
        return G.relative_volume(self.panel, self.members)

    def excess(self) -> DataFrame:
        own = self.returns.withColumn("own", G.trailing_sum("ret", "theme", 60)).select("theme", "date", "own")
        return G.excess_of(own, self.bench, 60)

    def demand(self) -> DataFrame:
        zs = cut(G.macro_zscores(self.macros))
        flows = self.panel.groupBy("date").agg(F.sum("volume").alias("net_flow"))
        return G.demand_score(self.volume(), self.excess(), G.fx_pressure(zs), flows)

    def scores(self) -> DataFrame:
        world = G.world_score(G.macro_zscores(self.macros))
        days = self.volume().select("theme", "date")
        sign = F.when(F.col("date") < F.lit("1997-01-01").cast("date"), 1.0).otherwise(-1.0)
        policy = days.where("month(date) <> 3").select("theme", "date", (sign * F.col("theme").cast("double").cast("int") / 2).alias("score"))
        return cut(G.theme_scores(days, self.demand(), policy, world))

    def weights(self) -> DataFrame:
        s = self.scores()
        day = Window.partitionBy("date")
        invested = F.when(F.max("score").over(day) < -0.5, 0.4).otherwise(1.0)
        even = F.max("score").over(day) - F.min("score").over(day) < 0.25
        soft = F.exp(G.clipped(F.col("score")))
        return s.select("theme", "date", (invested * F.when(even, 1.0 / F.count("*").over(day)).otherwise(soft / F.sum(soft).over(day))).alias("weight"))

    def by_symbol(self) -> DataFrame:
        return G.symbol_weights(self.weights(), self.members, self.panel.select("date", "instrument", F.col("close").alias("price")), ["date"])


@query(sql(_THEMES, f"SELECT theme, date, {shown_sql('relative_volume')} FROM vols"))
def relative_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Themes(spark, sf_dir).volume().select("theme", "date", shown("relative_volume"))


@query(sql(_THEMES, f"SELECT theme, date, {shown_sql('value')} FROM excess"))
def excess_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes against the mean of all names."""
    return _Themes(spark, sf_dir).excess().select("theme", "date", shown("value"))


@query(sql(_THEMES, f"SELECT date, {shown_sql('score')} FROM world"))
def world_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.world_score(G.macro_zscores(_Themes(spark, sf_dir).macros)).select("date", shown("score"))


@query(sql(_THEMES, f"SELECT theme, date, {shown_sql('score')} FROM demand"))
def demand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Themes(spark, sf_dir).demand().select("theme", "date", shown("score"))


@query(sql(_THEMES, f"SELECT theme, date, {shown_sql('score')} FROM scores"))
def theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Themes(spark, sf_dir).scores().select("theme", "date", shown("score"))


@query(sql(_THEMES, f"SELECT date, instrument, {shown_sql('weight')} FROM spread"))
def symbol_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Themes(spark, sf_dir).by_symbol().select("date", "instrument", shown("weight"))


@query(sql(_THEMES + """, lots AS (SELECT p.date, p.instrument, p.close AS price, coalesce(s.weight, 0) AS weight, 5 AS lot FROM p LEFT JOIN spread s ON s.date = p.date AND s.instrument = p.instrument WHERE s.weight IS NOT NULL OR p.instrument = 'NATION_7'),
c AS (SELECT *, weight > 0 AND coalesce(price > 0 AND 1e5 * weight >= lot * price, false) AS can FROM lots), r AS (SELECT *, sum(CASE WHEN NOT can AND weight > 0 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS residual FROM c),
o AS (SELECT date, instrument, CASE WHEN can THEN weight ELSE 0 END + CASE WHEN coalesce(instrument = 'NATION_7' AND residual > 0 AND price > 0 AND 1e5 * residual >= lot * price, false) THEN residual ELSE 0 END AS weight FROM r)""", f"SELECT date, instrument, {shown_sql('weight')} FROM o WHERE weight > 0"))
def lots_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that buy a lot of five with a hundred thousand; NATION_7 takes what is left."""
    t = _Themes(spark, sf_dir)
    rows = t.panel.select("date", "instrument", F.col("close").alias("price")).join(t.by_symbol(), ["date", "instrument"], "left").where("weight is not null or instrument = 'NATION_7'")
    return G.feasible_weights(rows.select("date", "instrument", "price", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(5).alias("lot")), 1e5, "NATION_7", ["date"]).select("date", "instrument", shown("weight"))


@query(sql(BARS + ", v AS (SELECT instrument, date, close / nullif(CAST(volume AS BIGINT) % 5, 0) AS pe, close / nullif(CAST(volume AS BIGINT) % 7, 0) AS pb, (CAST(volume AS BIGINT) % 5) / close AS earnings_yield FROM bars)", f"SELECT instrument, date, {_show('pe', 'pb', 'earnings_yield')} FROM v"))
def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("volume").cast("long")
    return G.valuation(bars(spark, sf_dir).withColumns({"eps": (v % 5).cast("double"), "book_value": (v % 7).cast("double")})).select("instrument", "date", *map(shown, ("pe", "pb", "earnings_yield")))


_CARDS = _INDICATORS + _RSI + f""", seen AS (SELECT f.*, count(f.close) OVER (PARTITION BY f.instrument ORDER BY f.date) AS bars, r.rsi, lag(f.close, 4) OVER (PARTITION BY f.instrument ORDER BY f.date) / nullif(lag(f.close, 26) OVER (PARTITION BY f.instrument ORDER BY f.date), 0) - 1 AS trend,
  lag(sma_10) OVER (PARTITION BY f.instrument ORDER BY f.date) AS was10, lag(sma_30) OVER (PARTITION BY f.instrument ORDER BY f.date) AS was30, row_number() OVER (PARTITION BY f.instrument ORDER BY f.date DESC) AS back FROM features f LEFT JOIN rsis r ON r.instrument = f.instrument AND r.date = f.date),
now AS (SELECT *, CASE WHEN was10 <= was30 AND sma_10 > sma_30 THEN 'buy' WHEN was10 >= was30 AND sma_10 < sma_30 THEN 'sell' ELSE 'hold' END AS side FROM seen WHERE back = 1),
cards AS (
  SELECT instrument, 'ma_crossover' AS strategy, 1 AS place, CASE WHEN bars < 31 OR sma_10 IS NULL OR sma_30 IS NULL THEN 'hold' ELSE side END AS action,
    CASE WHEN bars < 31 THEN 'short history' WHEN sma_10 IS NULL OR sma_30 IS NULL THEN 'no average' WHEN side = 'buy' THEN 'cross up' WHEN side = 'sell' THEN 'cross down' WHEN sma_10 > sma_30 THEN 'above' ELSE 'below' END AS reason, sma_10 AS x, sma_30 AS y FROM now
  UNION ALL SELECT instrument, 'rsi_mean_reversion', 2, CASE WHEN rsi < 30 THEN 'buy' WHEN rsi > 70 THEN 'sell' ELSE 'hold' END, CASE WHEN rsi IS NULL THEN 'short history' WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END, rsi, NULL FROM now
  UNION ALL SELECT instrument, 'tsmom', 3, CASE WHEN bars < 27 OR trend IS NULL THEN 'hold' WHEN trend > 0 THEN 'buy' ELSE 'sell' END, CASE WHEN bars < 27 THEN 'short history' WHEN trend IS NULL THEN 'no momentum' WHEN trend > 0 THEN 'rising' ELSE 'not rising' END, trend, NULL FROM now
  UNION ALL SELECT instrument, 'theme_rotation', 4, CASE WHEN instrument < 'NATION_2' THEN 'watch' ELSE 'hold' END, CASE WHEN instrument < 'NATION_2' THEN 'in early' ELSE 'in no theme' END, NULL, NULL FROM now)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rsi = T.smoothed(bars(spark, sf_dir)).select("instrument", "date", "rsi")
    seen = F.count("close").over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = T.features(panel(spark, sf_dir)).withColumns({"side": T.cross_side("sma_10", "sma_30"), "momentum": T.skipped_momentum(26, 4), "bars": seen}).withColumnsRenamed({"sma_10": "fast", "sma_30": "slow"})
    rows = cut(G.latest(rows.join(rsi, ["instrument", "date"], "left")))
    names = rows.select("instrument")
    members = names.where("instrument < 'NATION_2'").withColumn("theme", F.lit("early"))
    return G.cross_card(rows, 30).union(G.reversion_card(rows)).union(G.trend_card(rows, 26)).union(G.membership_card(names, members, "theme_rotation"))


@query(sql(_CARDS, f"SELECT instrument, strategy, action, reason, {_rest('x')} AS x, {_rest('y')} AS y FROM cards"))
def signal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("instrument", "strategy", "action", "reason", shown("x"), shown("y"))


@query(sql(_CARDS, f"SELECT instrument, headline, {_rest('x')} AS x, {_rest('y')} AS y, cards FROM (SELECT instrument, strategy || ': ' || reason AS headline, x, y, count(*) OVER (PARTITION BY instrument) AS cards FROM cards QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY CASE WHEN action IN ('buy', 'sell') THEN 0 ELSE 10 END + place) = 1)"))
def signal_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.headline(_cards(spark, sf_dir), ["ma_crossover", "rsi_mean_reversion", "tsmom", "theme_rotation"]).select("instrument", "headline", shown("x"), shown("y"), "cards")


@query(sql(_SERIES + """, v AS (SELECT *, CASE WHEN count(value) OVER w = 12 THEN stddev_samp(value) OVER w * sqrt(12) END AS vol FROM moved WINDOW w AS (PARTITION BY series_id ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
s AS (SELECT series_id, min(period_end) FILTER (value IS NOT NULL) > DATE '1993-06-30' AS short FROM moved GROUP BY series_id),
l AS (SELECT 'change' AS view, series_id, period_end, diff AS value FROM v UNION ALL SELECT 'level', series_id, period_end, value FROM v UNION ALL SELECT 'volatility', series_id, period_end, vol FROM v)""",
    f"SELECT view, l.series_id, period_end, {_rest('value')} AS value, short AS coverage_short FROM l JOIN s ON s.series_id = l.series_id WHERE period_end BETWEEN DATE '1993-06-30' AND DATE '1998-06-30'"))
def series_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = cut(_series(spark, sf_dir)), []
    for view in ("level", "change", "volatility"):
        out.append(G.series_view(s, view, F.lit("1998-06-30").cast("date")).select(F.lit(view).alias("view"), "series_id", "period_end", shown("value"), "coverage_short"))
    return out[0].union(out[1]).union(out[2])


@query(sql(_SERIES, """SELECT coalesce(c.series_id, s.series_id) AS series_id, coalesce(c.name, s.series_id) AS name, coalesce(observations, 0) AS observations, coalesce(last, DATE '1900-01-01') AS last
  FROM (SELECT DISTINCT o_orderpriority AS series_id, lower(substr(o_orderpriority, 3)) AS name FROM orders WHERE o_orderpriority < '4' UNION ALL SELECT '9-NONE', 'none') c
  FULL JOIN (SELECT series_id, count(value) AS observations, max(period_end) FILTER (value IS NOT NULL) AS last FROM series GROUP BY series_id) s ON s.series_id = c.series_id"""))
def series_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three catalogued series with data, one without, and what is stored beyond the catalogue."""
    known = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct().where("series_id < '4'").withColumn("name", F.lower(F.substring("series_id", 3, 50)))
    catalogue = known.union(spark.range(1).select(F.lit("9-NONE"), F.lit("none")))
    return G.catalogued(_series(spark, sf_dir), catalogue).select("series_id", "name", "observations", F.coalesce("last", F.lit("1900-01-01").cast("date")).alias("last"))


@query(sql(_THEMES, """SELECT 'event' AS kind, CAST(doc_id AS VARCHAR) AS name, substr(text, 1, 30) AS text FROM documents WHERE contains(lower(text), 'license') AND text IS NOT NULL
UNION ALL SELECT 'regime', name, CAST(a AS VARCHAR) || ' to ' || CAST(b AS VARCHAR) FROM (VALUES ('open', DATE '1997-01-01', DATE '1999-01-01')) r(name, a, b)
UNION ALL SELECT 'score', theme, printf('%.2f', arg_max(score, date)) FROM scores WHERE date <= DATE '1998-06-30' GROUP BY theme"""))
def brief_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a license as events, the regime that is open, and the scores as last known."""
    day = F.lit("1998-06-30").cast("date")
    articles = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("title"))
    regimes = bars(spark, sf_dir).select(F.lit("open").alias("name"), F.lit("1997-01-01").cast("date").alias("start"), F.lit("1999-01-01").cast("date").alias("end")).distinct()
    regimes = regimes.union(regimes.select(F.lit("over"), F.lit("1995-01-01").cast("date"), F.lit("1996-01-01").cast("date")))
    return G.brief(articles, regimes, _Themes(spark, sf_dir).scores(), day)

