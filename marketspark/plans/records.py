"""Queries on series, text, ledgers, quality, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.functions.algebra import evaluate, parse
from marketspark.operators import evaluation as E
from marketspark.operators import model as M
from marketspark.operators import panel as P
from marketspark.operators import records as R
from marketspark.plans import duck
from marketspark.plans.factors import EDGE, shown, shown_sql
from marketspark.plans.inputs import BARS, PANEL, bars, panel, sql, table
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


def _show(*names: str) -> str:
    return ", ".join(map(shown_sql, names))


# --- series: monthly order values by priority; the third month of each year is withheld to leave gaps --------------------
_SERIES = """
obs AS (
  SELECT o_orderpriority AS series_id, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS period_end, count(*) * 1.0 AS value
  FROM orders WHERE NOT (month(o_orderdate) = 3 AND o_orderpriority < '3') GROUP BY 1, 2
), grid AS (
  SELECT series_id, CAST(last_day(CAST(unnest(generate_series(date_trunc('month', min(period_end)), date_trunc('month', max(period_end)), INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS period_end FROM obs GROUP BY series_id
), series AS (SELECT g.series_id, g.period_end, o.value FROM grid g LEFT JOIN obs o ON g.series_id = o.series_id AND g.period_end = o.period_end),
moved AS (SELECT *, lag(value) OVER w AS before, value - lag(value) OVER w AS diff, (value / nullif(lag(value, 12) OVER w, 0) - 1) * 100 AS yoy FROM series WINDOW w AS (PARTITION BY series_id ORDER BY period_end))"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
    counts = orders.where("not (month(date) = 3 and series_id < '3')").groupBy("series_id", F.last_day("date").alias("date")).agg(F.count("*").cast("double").alias("value"))
    return R.monthly(counts)


@query(sql(_SERIES, f"SELECT series_id, period_end, {_show('value', 'diff', 'yoy')} FROM moved"))
def series_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changed(_series(spark, sf_dir)).select("series_id", "period_end", *map(shown, ("value", "diff", "yoy")))


@query(sql(_SERIES + """, ends AS (SELECT series_id, min(period_end) AS first, max(period_end) FILTER (value IS NOT NULL) AS last, count(value) AS n, count(*) - count(value) AS missing FROM moved GROUP BY series_id)""",
    f"SELECT e.series_id, e.first, e.last, {shown_sql('m.value').replace('AS m.value', 'AS latest')}, {shown_sql('m.before').replace('AS m.before', 'AS previous')}, {shown_sql('m.diff').replace('AS m.diff', 'AS change')}, n, missing FROM ends e JOIN moved m ON m.series_id = e.series_id AND m.period_end = e.last"))
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.series_summary(_series(spark, sf_dir)).select("series_id", "first", "last", *map(shown, ("latest", "previous", "change")), "n", "missing")


# --- text ---------------------------------------------------------------------------------------------------------------
_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"""
SELECT page_id, CASE WHEN regexp_matches(u, '^(?i:https?)://[^/@?#\\s]+(?:[/?][^\\s]*)?$') THEN u END AS url,
  CASE WHEN regexp_matches(u, '^(?i:https?)://[^/@?#\\s]+(?:[/?][^\\s]*)?$') THEN substr(sha256(u), 1, 20) END AS id,
  substr(trim(regexp_replace({_ENTITIES.format(x="regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '[ \\t\\r\\n]+', ' ', 'g')), 1, 400) AS text
FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)""")
def pages_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = R.safe_url("url")
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), R.article_id(url).alias("id"), R.plain("html", 400).alias("text"))


@query(f"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN
  substr(trim(regexp_replace({_ENTITIES.format(x="regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")}, '[ \\t\\r\\n]+', ' ', 'g')), 1, 400) END AS title,
  trim(regexp_replace({_ENTITIES.format(x="regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '[ \\t\\r\\n]+', ' ', 'g')) AS text
FROM pages""")
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text of each page; only the title is cut."""
    return table(spark, sf_dir, "pages").select("page_id", R.title("html").alias("title"), R.plain("html").alias("text"))


# Tag patterns.
TAGS = {"contact": "@[a-z]", "numbers": "[0-9]{4}", "question": "\\?"}


@query("""
SELECT doc_id, lang, CASE WHEN t = '' THEN 'other' ELSE t END AS tags FROM (
  SELECT doc_id, lang, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '@[a-z]') THEN 'contact' END, CASE WHEN regexp_matches(lower(text), '[0-9]{4}') THEN 'numbers' END,
    CASE WHEN regexp_matches(lower(text), '\\?') THEN 'question' END], lambda x: x IS NOT NULL), ',') AS t FROM documents)""")
def text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_join(R.tagged("text", TAGS, "other"), ",").alias("tags"))


@query("""
SELECT substr(sha256(text), 1, 20) AS id, min(doc_id) AS first_seen, arg_max(source, doc_id) AS source FROM documents GROUP BY text""")
def articles_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(R.article_id(F.col("text")).alias("id"), F.col("doc_id").alias("first_seen"), "source")
    return R.first_seen(docs.where("first_seen % 2 = 0"), docs.where("first_seen % 2 = 1")).select("id", "first_seen", "source")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'the') AND NOT contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 300")
def articles_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 300 that hold a term and lack another: the limit is the feature."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.contains(low, F.lit("the")) & ~F.contains(low, F.lit("license"))).orderBy(F.desc("doc_id")).limit(300).select("doc_id", "source")


# Regimes as name, start, end, scores.
REGIMES = [("easing", "1995-06-01", "1997-12-31", {"NATION_1": 1, "NATION_2": 2}), ("audit", "1997-01-01", "1999-06-30", {"NATION_1": -1, "NATION_2": 1, "NATION_3": -2})]


@query(sql(BARS, """
SELECT date, theme, greatest(least(sum(s), 2), -2) AS score FROM (SELECT DISTINCT date FROM bars) d JOIN (VALUES
  (DATE '1995-06-01', DATE '1997-12-31', 'NATION_1', 1), (DATE '1995-06-01', DATE '1997-12-31', 'NATION_2', 2), (DATE '1997-01-01', DATE '1999-06-30', 'NATION_1', -1),
  (DATE '1997-01-01', DATE '1999-06-30', 'NATION_2', 1), (DATE '1997-01-01', DATE '1999-06-30', 'NATION_3', -2)) r(a, b, theme, s) ON d.date BETWEEN r.a AND r.b GROUP BY date, theme"""))
def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    regimes = spark.createDataFrame(REGIMES, "name string, start string, end string, scores map<string,bigint>").selectExpr("name", "to_date(start) start", "to_date(end) end", "scores")
    return R.policy_scores(bars(spark, sf_dir).select("date").distinct(), regimes)


# --- ledgers: books are market segments, symbols are brands, returned lines are sells ------------------------------------
_TRADES = """
trades AS (
  SELECT c_mktsegment AS book, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
    round(l_extendedprice / l_quantity, 4) AS price, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), costs AS (SELECT *, greatest(quantity * price * 0.0003, 1.0) + CASE WHEN side = 'sell' THEN quantity * price * 0.0005 ELSE 0.0 END AS fee, CASE WHEN side = 'sell' THEN -quantity ELSE quantity END AS signed FROM trades)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their brand meet orders with their segment, so lines are shuffled twice, by narrow rows, and once if
    few brands are asked for."""
    lines, orders, customers, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    priced = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    lines = lines.select(*keys, F.col("l_quantity").alias("quantity"), priced.alias("price"), F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("sell"))
    books = orders.select("o_orderkey", "o_custkey").join(customers.select("c_custkey", F.col("c_mktsegment").alias("book")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "book")
    branded = lines.join(part.select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
    rows = branded.join(books, F.col("l_orderkey") == F.col("o_orderkey"))
    side = F.when(F.col("sell"), "sell").otherwise("buy")
    return rows.select("book", "symbol", side.alias("side"), "quantity", "price", R.fees(side, F.col("quantity") * F.col("price")).alias("fee"), F.struct(*keys).alias("at"))


@query(sql(_TRADES, """SELECT book, symbol, sum(signed) AS holding, round(sum(-signed * price - fee) * 1.000000001, 0) AS cash, count(*) AS trades, round(sum(fee), 2) AS fees FROM costs GROUP BY book, symbol"""))
def ledger_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every book's running holding and cash end."""
    last = R.positions(_trades(spark, sf_dir)).groupBy("book", "symbol").agg(F.max_by(F.struct("holding", "cash"), "at").alias("l"), F.count("*").alias("trades"), F.round(F.sum("fee"), 2).alias("fees"))
    return last.select("book", "symbol", "l.holding", F.round(F.col("l.cash") * EDGE, 0).alias("cash"), "trades", "fees")


@query(sql(_TRADES + """, cum AS (SELECT *, sum(quantity) OVER (PARTITION BY book, symbol, side ORDER BY seq) AS hi FROM costs),
m AS (SELECT b.book, least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity) AS quantity, b.price AS buy_price, s.price AS sell_price FROM cum b JOIN cum s
  ON b.book = s.book AND b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.hi - b.quantity < s.hi AND s.hi - s.quantity < b.hi)""",
    "SELECT book, count(*) AS slices, round(avg(CASE WHEN sell_price > buy_price THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(quantity * (sell_price - buy_price)) * 1.000000001, -2) AS profit FROM m GROUP BY book"))
def ledger_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.win_rate(R.fifo_matches(_trades(spark, sf_dir))).select("book", "slices", F.round("win_rate", 6).alias("win_rate"), F.round(F.col("profit") * EDGE, -2).alias("profit"))


@query(sql(BARS + """, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument ORDER BY date) % 50 = 0 THEN 2.0 ELSE 1.0 END AS split FROM bars),
f AS (SELECT *, coalesce(product(split) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS factor FROM s),
n AS (SELECT instrument, date, factor, close * factor AS close, volume / factor AS volume FROM f)""", f"SELECT instrument, date, factor, {_show('close', 'volume')} FROM n"))
def nominal_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth bar of an instrument is read as a two-for-one split."""
    nth = F.row_number().over(Window.partitionBy("instrument").orderBy("date"))
    return R.nominal_prices(bars(spark, sf_dir).withColumn("split", F.when(nth % 50 == 0, 2.0).otherwise(1.0))).select("instrument", "date", "factor", shown("close"), shown("volume"))


@query(sql(BARS + """, q AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY date), 0) - 1) AS move FROM bars)""", """
SELECT instrument, date, 'gap' AS reason, 'warning' AS severity FROM q WHERE move > 0.35
UNION ALL SELECT instrument, date, 'envelope', 'warning' FROM q WHERE high + 1e-6 < greatest(open, close) OR low - 1e-6 > least(open, close)
UNION ALL SELECT instrument, date, 'not positive', 'error' FROM q WHERE NOT coalesce(least(open, high, low, close) > 0, false)"""))
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_issues(bars(spark, sf_dir))


@query(sql(BARS, f"SELECT upper(instrument) AS code, date, {_show('open', 'close', 'high', 'low', 'volume')} FROM (SELECT instrument, date, round(open * 1.000000001, 2) AS open, round(close * 1.000000001, 2) AS close, round(high * 1.000000001, 2) AS high, round(low * 1.000000001, 2) AS low, volume FROM bars)"))
def feed_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as feed lines, with a broken line for each, and read again."""
    b = bars(spark, sf_dir).select(F.concat("instrument", F.lit(".xx")).alias("raw"), "date", *[F.round(F.col(c) * EDGE, 2).alias(c) for c in ("open", "close", "high", "low")], "volume")
    good = b.select("raw", F.concat_ws(",", F.col("date").cast("string"), *[F.format_string("%.2f", c) for c in ("open", "close", "high", "low", "volume")]).alias("line"))
    return R.klines(good.union(b.select("raw", F.concat_ws(",", F.col("date").cast("string"), F.lit("1")).alias("line")))).select(R.symbol_code("raw").alias("code"), "date", *map(shown, ("open", "close", "high", "low", "volume")))


@query("""
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(sql(BARS, "SELECT instrument, count(*) AS n, min(date) AS first, max(date) AS last FROM bars GROUP BY instrument"))
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manifest(bars(spark, sf_dir)).drop("digest")


@query(sql(BARS, "SELECT instrument, date, 'close differs' AS reason FROM bars WHERE close > 2000 AND date <= DATE '2000-01-03' UNION ALL SELECT instrument, date, 'only in a' FROM bars WHERE date > DATE '2000-01-03'"))
def audit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bars(spark, sf_dir).select("instrument", "date", "close")
    b = a.where("date <= '2000-01-03'").withColumn("close", F.when(F.col("close") > 2000, F.col("close") + 1).otherwise(F.col("close")))
    return P.differences(a, b, ["instrument", "date"], ["close"])


# --- models -------------------------------------------------------------------------------------------------------------
_X = {"x1": "rank(delta(close, 1))", "x2": "rank(volume / adv(20))"}


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate(panel(spark, sf_dir), {n: parse(f) for n, f in _X.items()}, ["date", "instrument", "close"])
    rows = M.lagged(M.labelled(p, 1), list(_X))
    rows = rows.withColumn("label", E.rank_label(rows, "label", ["date"]))
    return M.purged_split(rows, 0.6, 1, 5)


@query(sql(PANEL + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS sessions FROM (SELECT DISTINCT date FROM panel))""",
    "SELECT date, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal >= floor(sessions * 0.6) THEN 'test' WHEN ordinal < floor(sessions * 0.6) - 6 THEN 'train' END AS part FROM d"))
def model_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).select("date", "ordinal", "part").distinct()


_MODELLED, _ = duck.evaluated({n: parse(f) for n, f in _X.items()})
#: Average ranks within the date as shares of its count; least squares of two features in closed form; rank correlations.
PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY round({x}, 9) NULLS LAST) + count({x}) OVER (PARTITION BY {by}) - rank() OVER (PARTITION BY {by} ORDER BY round({x}, 9) DESC NULLS LAST) + 1) / 2.0 / count({x}) OVER (PARTITION BY {by}) END"
LEAST_SQUARES = """sums AS (SELECT fold, count(*) AS n, count(DISTINCT date) AS dates, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM taught WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY fold),
fits AS (SELECT fold, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) AS b1, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) AS b2, m1, m2, my FROM sums WHERE n >= 100 AND dates >= 60),
scored AS (SELECT t.fold, date, instrument, label, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS prediction FROM tested t JOIN fits USING (fold) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND label IS NOT NULL),
ranked AS (SELECT fold, date, """ + PCT.format(x="prediction", by="fold, date") + " AS px, " + PCT.format(x="label", by="fold, date") + """ AS py FROM scored),
daily AS (SELECT fold, date, count(*) AS n, CASE WHEN count(*) >= 5 AND var_pop(px) > 1e-14 AND var_pop(py) > 1e-14 THEN covar_pop(px, py) / sqrt(var_pop(px) * var_pop(py)) END AS rank_ic FROM ranked GROUP BY fold, date)"""


@query(sql(PANEL + ", " + _MODELLED + f""", d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS sessions FROM (SELECT DISTINCT date FROM panel)),
raw AS (SELECT date, instrument, lag(x1) OVER w AS x1, lag(x2) OVER w AS x2, lead(close) OVER w / nullif(close, 0) - 1 AS ahead FROM evaluated WINDOW w AS (PARTITION BY instrument ORDER BY date)),
named AS (SELECT *, {PCT.format(x='ahead', by='date')} - 0.5 AS y FROM raw),
taught AS (SELECT 0 AS fold, named.* FROM named JOIN d USING (date) WHERE ordinal < floor(sessions * 0.6) - 6), tested AS (SELECT 0 AS fold, date, instrument, x1, x2, y AS label FROM named JOIN d USING (date) WHERE ordinal >= floor(sessions * 0.6)),
""" + LEAST_SQUARES, f"SELECT date, {shown_sql('rank_ic')}, n FROM daily"))
def model_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of a linear model on the test sessions."""
    scored = M.fit_predict(_dataset(spark, sf_dir), list(_X))
    return E.daily_rank_ic(scored, ["date"], "prediction", "label").select("date", shown("rank_ic"), F.col("n").cast("long"))


@query()
def model_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.fit_predict(_dataset(spark, sf_dir), list(_X), "trees")
    return E.daily_rank_ic(scored, ["date"], "prediction", "label").select("date", shown("rank_ic"), F.col("n").cast("long"))


# --- streams ------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = feeds.unseen(rows, ["user_id", "event_type"])
    return feeds.drained(stream, feeds.work_folder(spark)).select("user_id", "event_type")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.source(spark, f"{sf_dir}/events.parquet").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "ts", "value")
    return feeds.upserted(rows, feeds.work_folder(spark), ["event_type", "hour"], "ts").select("event_type", "hour", "value")
