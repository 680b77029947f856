"""Queries on alignment, news, proposals, fees, periods, option expiries and further weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators import desk as K
from marketspark.operators import indicators as T
from marketspark.operators import model as M
from marketspark.operators import news as N
from marketspark.operators import options as X
from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators.intervals import held_totals
from marketspark.plans.desk import _DATED, _DUAL, _dated
from marketspark.plans.factors import shown, shown_sql
from marketspark.plans.inputs import BARS, PANEL, bars, fills, panel, sql, table
from marketspark.plans.market import LINE, _show
from marketspark.plans.records import _dataset

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


@query(sql(BARS, f"SELECT a.date, a.instrument, {_rest('a.close')} AS x, {_rest('b.vwap')} AS y FROM bars a JOIN bars b ON a.date = b.date AND a.instrument = b.instrument WHERE a.date >= DATE '1996-01-01' AND b.instrument < 'NATION_2'"))
def factors_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    both = P.align(b.where("date >= '1996-01-01'").select("date", "instrument", F.col("close").alias("x")), b.where("instrument < 'NATION_2'").select("date", "instrument", F.col("vwap").alias("y")))
    return both.select("date", "instrument", shown("x"), shown("y"))


@query(sql(BARS, f"SELECT instrument, date, {shown_sql('close')} FROM bars WHERE month(date) = 6"))
def bars_on_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return P.on_dates(b, b.select("date").distinct().where("month(date) = 6")).select("instrument", "date", shown("close"))


@query("""SELECT o.o_orderkey, coalesce((SELECT max(v.o_orderkey) FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) v
  WHERE v.o_custkey = o.o_custkey AND v.d = (SELECT max(CAST(p.o_orderdate AS DATE)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND CAST(p.o_orderdate AS DATE) <= CAST(o.o_orderdate AS DATE))), -1) AS latest FROM orders o""")
def orders_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the customer's latest finished one up to its day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    done = o.where("o_orderstatus = 'F'").groupBy("o_custkey", "day").agg(F.max("o_orderkey").alias("latest"))
    return P.asof(o.select("o_orderkey", "o_custkey", "day"), done, "o_custkey", "day", "latest").select("o_orderkey", F.coalesce("latest", F.lit(-1)).alias("latest"))


@query("SELECT event_type AS instrument, CAST(ts - INTERVAL 8 HOUR AS DATE) AS date, round(arg_max(value, ts), 6) AS close FROM events GROUP BY 1, 2")
def sessions_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as local times of Shanghai; the last of each date in UTC."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("value").alias("close"))
    return P.session_bars(rows, "at", "Asia/Shanghai").select("instrument", "date", F.round("close", 6).alias("close"))


@query(sql(BARS, f"""SELECT instrument, date, {_rest('CASE WHEN date < DATE ' + chr(39) + '1998-01-01' + chr(39) + ' OR instrument < ' + chr(39) + 'NATION_2' + chr(39) + ' THEN close ELSE vwap END')} AS close FROM bars"""))
def composite_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before NATION_2 are covered by the first source; of others it has only what is before 1998."""
    b = bars(spark, sf_dir)
    first = b.where("date < '1998-01-01' or instrument < 'NATION_2'").select("instrument", "date", "close")
    return P.composite(first, b.select("instrument", "date", F.col("vwap").alias("close")), "1995-01-01", "2001-10-31", 40).select("instrument", "date", shown("close"))


@query(sql(PANEL, f"SELECT date, instrument, last_value(CASE WHEN date < DATE '1997-01-01' AND close IS NOT NULL THEN industry END IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS industry FROM panel"))
def industries_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries known until 1997, carried to all later sessions."""
    p = panel(spark, sf_dir)
    return P.carried_industries(p.select("date"), p.where("date < '1997-01-01' and close is not null").select("instrument", "date", "industry"))


@query(sql(PANEL + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))""", "SELECT CAST(ordinal AS INTEGER) AS ordinal FROM d WHERE ordinal < floor(n * 0.6) - 6 AND ordinal + 20 >= floor(n * 0.6)"))
def model_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sessions that a label of twenty sessions would carry into the test."""
    return M.leakage(_dataset(spark, sf_dir), 20).select("ordinal")


_ITEMS = """items AS (SELECT doc_id, source AS region, 'See <b>' || substr(text, 1, 30) || '</b> &amp; more' AS title, CASE WHEN doc_id % 7 = 0 THEN 'ftp://x/' WHEN doc_id % 7 = 1 THEN 'https://user@host/' ELSE 'https://host/' END || CAST(doc_id AS VARCHAR) || '#part' AS link,
  TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 HOUR * doc_id AS moment FROM documents WHERE text IS NOT NULL)"""


@query("WITH " + _ITEMS + """, clean AS (SELECT doc_id, region, regexp_replace(link, '#.*$', '') AS url, CASE WHEN doc_id % 5 <> 0 THEN moment - INTERVAL 2 HOUR END AS published_at FROM items WHERE doc_id % 7 > 1 AND NOT (doc_id % 5 <> 0 AND moment - INTERVAL 2 HOUR > TIMESTAMP '2024-01-20 00:00:00'))
SELECT substr(sha256(url), 1, 20) AS id, url, published_at, region FROM clean""")
def news_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items, with addresses that must not pass, dates two hours east, without a zone, and in the future."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    at = F.expr("timestamp_ntz'2024-01-01 10:00:00'") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    month = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), F.month(at))
    date = F.concat_ws(" ", F.lit("Mon,"), F.dayofmonth(at).cast("string"), month, F.year(at).cast("string"), F.date_format(at, "HH:mm:ss"), F.when(F.col("doc_id") % 5 != 0, F.lit("+0200")))
    link = F.concat(F.when(F.col("doc_id") % 7 == 0, "ftp://x/").when(F.col("doc_id") % 7 == 1, "https://user@host/").otherwise("https://host/"), F.col("doc_id").cast("string"), F.lit("#part"))
    items = docs.select(F.col("source").alias("region"), F.concat(F.lit("See <b>"), F.substring("text", 1, 30), F.lit("</b> &amp; more")).alias("title"), link.alias("link"), date.alias("published"))
    return N.articles(items, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("id", "url", "published_at", "region")


@query("SELECT doc_id, lang AS region, matched_count FROM (SELECT doc_id, lang, count(*) OVER () AS matched_count FROM documents WHERE lang = 'en' AND contains(lower(substr(text, 1, 400)), 'the') AND doc_id >= 100) ORDER BY doc_id DESC LIMIT 300")
def news_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("region"), F.array(F.lit("a")).alias("tags"), F.substring("text", 1, 400).alias("title"), F.col("doc_id").alias("published_at"))
    return N.filtered(rows, "en", "a", "THE", F.lit(100)).select("doc_id", "region", "matched_count")


@query("SELECT id, moment FROM (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) AS id, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS moment FROM documents) ORDER BY moment DESC NULLS LAST, id LIMIT 500")
def news_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20).alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("moment"))
    return N.newest(rows, "moment", 500)


_WORDS = (("that", "ent"), ("idiot", "moron", "ing"), ("license",))


def _any(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


@query(f"SELECT doc_id, coalesce({_any(_WORDS[0])} AND (NOT {_any(_WORDS[1])} OR {_any(_WORDS[2])}), false) AS event FROM documents")
def policy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.policy_event(F.col("text"), *_WORDS).alias("event"))


@query("""SELECT event_id, CASE k % 6 WHEN 0 THEN 'apply' WHEN 1 THEN 'no_change' WHEN 4 THEN 'apply' END AS decision, CASE k % 6 WHEN 0 THEN 'r' WHEN 4 THEN 'untitled_regime' END AS name, CASE WHEN k % 6 IN (0, 4) THEN k ELSE -1 END AS score,
  CASE k % 6 WHEN 2 THEN 'not json' WHEN 3 THEN 'sentiment' WHEN 5 THEN 'no scores' END AS error FROM (SELECT event_id, event_id % 50 AS k FROM events)""")
def proposals_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as proposals of six kinds: whole, unchanged, broken, about sentiment, fenced without a name, without scores."""
    k = (F.col("event_id") % 50).cast("string")
    forms = [F.concat(F.lit('{"name":"r","scores":{"t":'), k, F.lit("}}")), F.lit("no_change"), F.lit("{oops"), F.lit('{"Sentiment":1,"scores":{"t":1}}'), F.concat(F.lit('```json\n{"scores":{"t":'), k, F.lit(".0}}\n```")), F.lit('{"name":"x"}')]
    raw = F.element_at(F.array(*forms), ((F.col("event_id") % 50) % 6 + 1).cast("int"))
    rows = N.proposals(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    return rows.select("event_id", "decision", "name", F.coalesce(F.col("scores")["t"], F.lit(-1)).alias("score"), "error")


_FEES = """orders_ AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS venue, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN l_suppkey % 4 = 0 THEN 'fund' WHEN l_suppkey % 4 = 1 THEN 'option' ELSE 'equity' END AS kind, l_quantity AS quantity, l_extendedprice / l_quantity AS price FROM lineitem),
profiles AS (SELECT * FROM (VALUES ('us', 0.0005, 0.0, 0.0, 0.0001, 0.0), ('hk', 0.001, 0.0003, 0.001, 0.0014, 18.0), ('cn', 0.001, 0.0003, 0.0005, NULL, 5.0)) p(venue, slippage, commission, stamp, all_in, minimum)),
f AS (SELECT o.*, p.* EXCLUDE (venue), price * (1 + CASE WHEN side = 'buy' THEN slippage ELSE -slippage END) AS fill FROM orders_ o JOIN profiles p ON o.venue = p.venue),
g AS (SELECT venue, side, kind, fill, fill * quantity * CASE WHEN kind = 'option' THEN 100 ELSE 1 END AS amount, coalesce(all_in, commission + CASE WHEN side = 'sell' AND kind = 'equity' THEN stamp ELSE 0 END) AS rate, commission, minimum FROM f)"""


@query("WITH " + _FEES + f" SELECT venue, side, kind, count(*) AS n, {_rest('sum(fill)')} AS fill, {_rest('sum(amount * rate + greatest(0.0, minimum - amount * commission))')} AS fee FROM g GROUP BY venue, side, kind")
def venue_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as orders at three venues with fee schedules of their own."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.element_at(F.array(F.lit("us"), F.lit("hk"), F.lit("cn")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("venue"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.when(F.col("l_suppkey") % 4 == 0, "fund").when(F.col("l_suppkey") % 4 == 1, "option").otherwise("equity").alias("kind"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    profiles = spark.createDataFrame([("us", 0.0005, 0.0, 0.0, 0.0001, 0.0), ("hk", 0.001, 0.0003, 0.001, 0.0014, 18.0), ("cn", 0.001, 0.0003, 0.0005, None, 5.0)], "venue string, slippage double, commission double, stamp double, all_in double, minimum double")
    return K.filled(rows, profiles).groupBy("venue", "side", "kind").agg(F.count("*").alias("n"), F.sum("fill_price").alias("fill"), F.sum("fee").alias("fee")).select("venue", "side", "kind", "n", shown("fill"), shown("fee"))


_PERIODS = "periods AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS venue, s_suppkey AS id, DATE '1992-01-01' + CAST(s_suppkey * 37 % 2500 AS INTEGER) AS valid_from, DATE '1992-01-01' + CAST(s_suppkey * 37 % 2500 + s_suppkey % 97 AS INTEGER) AS valid_to, (s_suppkey % 7) / 10000.0 AS rate FROM supplier)"


@query("WITH " + _PERIODS + f""", o AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS venue, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS amount FROM lineitem)
SELECT venue, id, count(*) AS n, {_rest('sum(amount * rate)')} AS fees FROM (SELECT o.venue, id, amount, rate FROM o JOIN periods p ON o.venue = p.venue AND day BETWEEN valid_from AND valid_to) GROUP BY venue, id""")
def fees_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as orders under surcharges that each hold for a time; periods overlap and leave gaps. A period's rate is one,
    so it is taken of what the period holds in all, and no order meets a period."""
    venue = lambda x: F.element_at(F.array(F.lit("us"), F.lit("hk"), F.lit("cn")), (x % 3 + 1).cast("int")).alias("venue")
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") * 37 % 2500).cast("int"))
    periods = table(spark, sf_dir, "supplier").select(venue(F.col("s_suppkey")), F.col("s_suppkey").alias("id"), start.alias("valid_from"), F.date_add(start, (F.col("s_suppkey") % 97).cast("int")).alias("valid_to"), (F.col("s_suppkey") % 7 / 10000.0).alias("rate"))
    orders = table(spark, sf_dir, "lineitem").select(venue(F.col("l_linenumber")), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("amount"))
    met = held_totals(orders, periods, "day", "valid_from", "valid_to", ["venue"], ["amount"])
    return met.groupBy("venue", "id").agg(F.sum("n").alias("n"), F.sum(F.col("amount") * F.col("rate")).alias("fees")).select("venue", "id", "n", shown("fees"))


_SIDES = """a AS (SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag FROM lineitem WHERE l_linenumber < 4 UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), l_returnflag FROM lineitem WHERE l_orderkey % 50 = 0),
b AS (SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag FROM lineitem WHERE l_linenumber < 4 AND l_orderkey % 40 <> 0)"""


@query("WITH " + _SIDES + """, x AS (SELECT supplier, day, flag, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT supplier, day, flag, count(*) AS n FROM b GROUP BY ALL)
SELECT supplier, day, flag, coalesce(x.n, 0) AS in_a, coalesce(y.n, 0) AS in_b FROM x FULL JOIN y USING (supplier, day, flag) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def audit_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers as multisets: rows repeat on both sides, some more often on one, some are missing."""
    rows = table(spark, sf_dir, "lineitem")
    made = [F.col("l_suppkey").alias("supplier"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")]
    a = rows.where("l_linenumber < 4").select(*made).unionByName(rows.where("l_orderkey % 50 = 0").select(*made))
    return P.multiset_differences(a, rows.where("l_linenumber < 4 and l_orderkey % 40 <> 0").select(*made))


_BARS2 = _DATED + ", days2 AS (SELECT symbol, date, arg_max(price, seq) AS close FROM costs GROUP BY symbol, date)"


def _period_sql(period: str) -> str:
    start = f"CAST(date_trunc('{period}', DATE '1998-06-10') AS DATE)"
    return f"""SELECT book, '{period}' AS period, CASE WHEN count(r) = count(*) THEN sum(r) END AS result FROM (SELECT h.book, CASE WHEN q1 = 0 THEN 0 ELSE q1 * p1 END - CASE WHEN q0 = 0 THEN 0 ELSE q0 * p0 END + flow AS r FROM (
  SELECT book, symbol, sum(CASE WHEN date < {start} THEN signed ELSE 0 END) AS q0, sum(signed) AS q1, sum(CASE WHEN date >= {start} THEN -signed * price - fee ELSE 0 END) AS flow FROM costs WHERE date <= DATE '1998-06-10' GROUP BY book, symbol) h
  LEFT JOIN (SELECT symbol, arg_max(close, date) FILTER (date < {start}) AS p0, arg_max(close, date) FILTER (date <= DATE '1998-06-10') AS p1 FROM days2 GROUP BY symbol) m ON m.symbol = h.symbol) GROUP BY book"""


@query(sql(_BARS2 + ", res AS (" + " UNION ALL ".join(map(_period_sql, ("day", "week", "month"))) + ")", "SELECT book, period, round(result / 1e6 + 0.0000137, 3) + 0.0 AS result FROM res"))
def book_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a day, its week and its month, in millions (prices are rounded to four digits, which engines do unlike)."""
    t = _dated(spark, sf_dir)
    marks = t.groupBy("symbol", "date").agg(F.max_by("price", "at").alias("close"))
    return K.period_results(t, marks, F.lit("1998-06-10").cast("date")).select("book", "period", F.round(F.col("result") / 1e6 + 0.0000137, 3).alias("result"))


@query(sql(_BARS2 + """, b AS (SELECT DISTINCT book, date FROM costs), s AS (SELECT DISTINCT book, symbol FROM costs), g AS (SELECT b.book, b.date, s.symbol FROM b JOIN s ON b.book = s.book),
h AS (SELECT book, symbol, date, sum(sum(signed)) OVER (PARTITION BY book, symbol ORDER BY date) AS held FROM costs GROUP BY book, symbol, date),
v AS (SELECT g.book, g.date, sum(coalesce(h.held, 0) * coalesce(d.close, 0)) AS value FROM g ASOF LEFT JOIN h ON g.book = h.book AND g.symbol = h.symbol AND g.date >= h.date ASOF LEFT JOIN days2 d ON d.symbol = g.symbol AND g.date >= d.date GROUP BY g.book, g.date),
c AS (SELECT book, date, 1e9 + sum(sum(-signed * price - fee)) OVER (PARTITION BY book ORDER BY date) AS cash FROM costs GROUP BY book, date),
e AS (SELECT c.book, c.date, cash + value AS equity FROM c JOIN v ON v.book = c.book AND v.date = c.date),
f AS (SELECT book, date, equity, equity - coalesce(lag(equity) OVER (PARTITION BY book ORDER BY date), 1e9) AS pnl, equity / greatest(1e9, max(equity) OVER (PARTITION BY book ORDER BY date)) - 1 AS drawdown FROM e)""",
    f"SELECT book, date, {_show('equity')}, round(pnl / 1e6 + 0.0000137, 3) + 0.0 AS pnl, {_show('drawdown')} FROM f"))
def ledger_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in millions."""
    t = _dated(spark, sf_dir)
    marks = t.groupBy("symbol", "date").agg(F.max_by("price", "at").alias("close"))
    return K.equity_ledger(t, marks, 1e9).withColumn("pnl", F.round(F.col("pnl") / 1e6 + 0.0000137, 3)).select("book", "date", shown("equity"), "pnl", shown("drawdown"))


@query(sql(BARS, """SELECT date, coalesce(min(e) FILTER (e - date BETWEEN 21 AND 90), min(e) FILTER (e >= date)) AS expiry FROM (SELECT DISTINCT date FROM bars) d,
  (SELECT CAST(m + CAST((5 - dayofweek(m) + 7) % 7 + 14 AS INTEGER) AS DATE) AS e FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM bars WHERE month(date) % 3 = 0 AND date < DATE '1998-12-31')) x WHERE date < DATE '1998-12-01' GROUP BY date"""))
def expiries_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the quarterly expiries the one to trade on each session."""
    b = bars(spark, sf_dir)
    months = b.where("month(date) % 3 = 0 and date < '1998-12-31'").select(F.trunc("date", "month").alias("m")).distinct()
    all_ = months.agg(F.collect_set(X.third_friday(F.col("m"))).alias("e"))  # four a year
    return b.where("date < '1998-12-01'").select("date").distinct().crossJoin(F.broadcast(all_)).select("date", X.chosen_expiry(F.col("e"), F.col("date")).alias("expiry"))


@query(sql(BARS, """SELECT date, coalesce(max(e) FILTER (e - date BETWEEN 21 AND 200), max(e) FILTER (e - date >= 21)) AS longest, coalesce(min(e) FILTER (e - date BETWEEN 21 AND 200), min(e) FILTER (e - date >= 21)) AS nearest FROM (SELECT DISTINCT date FROM bars) d,
  (SELECT CAST(m + CAST((5 - dayofweek(m) + 7) % 7 + 14 AS INTEGER) AS DATE) AS e FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM bars WHERE month(date) % 3 = 0 AND (date < DATE '1996-01-01' OR date > DATE '1997-01-01'))) x WHERE date < DATE '1998-06-01' GROUP BY date"""))
def expiries_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the quarterly expiries, a year's missing, the longest and the nearest that standard rules allow."""
    b = bars(spark, sf_dir)
    months = b.where("month(date) % 3 = 0 and (date < '1996-01-01' or date > '1997-01-01')").select(F.trunc("date", "month").alias("m")).distinct()
    all_ = months.agg(F.collect_set(X.third_friday(F.col("m"))).alias("e"))  # four a year
    pick = lambda longest: X.standard_expiry(F.col("e"), F.col("date"), 21, 200, longest)
    return b.where("date < '1998-06-01'").select("date").distinct().crossJoin(F.broadcast(all_)).select("date", pick(True).alias("longest"), pick(False).alias("nearest"))


_CHECKS = BARS + """, quotes AS (SELECT instrument AS symbol, date, close, volume, lag(close) OVER (PARTITION BY instrument ORDER BY date) AS before, lag(volume) OVER (PARTITION BY instrument ORDER BY date) AS prior FROM bars WHERE month(date) % 5 <> 0),
orders AS (SELECT instrument AS symbol, date, seq, quantity, CASE WHEN industry % 2 = 0 THEN 'us' ELSE 'cn' END AS venue, CASE WHEN CAST(quantity AS BIGINT) % 10 = 3 THEN 'option' ELSE 'equity' END AS kind, CASE WHEN CAST(quantity AS BIGINT) % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, 21.0 AS held FROM fills),
rules AS (SELECT * FROM (VALUES ('us', 'equity', 1, NULL), ('us', 'option', 1, NULL), ('cn', 'equity', 5, 0.195)) r(venue, kind, lot, lim)),
joined AS (SELECT o.*, q.date AS day, close, before, volume, prior, lot, lim FROM orders o ASOF LEFT JOIN quotes q ON o.symbol = q.symbol AND o.date >= q.date LEFT JOIN rules r ON o.venue = r.venue AND o.kind = r.kind),
judged AS (SELECT *, CASE WHEN lot IS NULL THEN 'class' WHEN CAST(quantity AS BIGINT) % lot <> 0 AND NOT (side = 'sell' AND quantity = held) THEN 'board lot' WHEN day IS NULL THEN 'no quote' WHEN date - day > 7 THEN 'stale quote' WHEN abs(close / nullif(before, 0) - 1) >= lim THEN 'limit move' END AS reason,
  floor(floor(coalesce(CASE WHEN day < date THEN volume ELSE prior END, 0) * 0.05) / coalesce(lot, 1)) * coalesce(lot, 1) AS cap FROM joined),
summed AS (SELECT *, CASE WHEN reason IS NULL THEN quantity ELSE 0 END AS asked, sum(CASE WHEN reason IS NULL THEN quantity ELSE 0 END) OVER (PARTITION BY symbol, date ORDER BY seq) AS upto FROM judged),
filled AS (SELECT *, CASE WHEN reason IS NULL THEN least(upto, cap) - least(upto - asked, cap) ELSE 0 END AS filled FROM summed)"""


@query(sql(_CHECKS, "SELECT venue, kind, coalesce(reason, CASE WHEN filled <= 0 THEN 'volume cap' ELSE 'ok' END) AS reason, count(*) AS n, sum(filled) AS filled FROM filled GROUP BY 1, 2, 3"))
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills read as orders at two venues with classes, lots and limits of their own; bars of some months are missing, so
    quotes grow stale."""
    whole = F.col("quantity").cast("long")
    orders = fills(spark, sf_dir).select(
        F.col("instrument").alias("symbol"), "date", "at", "quantity", F.when(F.col("industry") % 2 == 0, "us").otherwise("cn").alias("venue"), F.when(whole % 10 == 3, "option").otherwise("equity").alias("kind"),
        F.when(whole % 3 == 0, "sell").otherwise("buy").alias("side"), F.lit(21.0).alias("held"),
    )
    rules = spark.createDataFrame([("us", "equity", 1, None), ("us", "option", 1, None), ("cn", "equity", 5, 0.195)], "venue string, kind string, lot int, limit double")
    quotes = bars(spark, sf_dir).where("month(date) % 5 <> 0").withColumnRenamed("instrument", "symbol")
    return K.order_checks(orders, quotes, rules, share=0.05).groupBy("venue", "kind", "reason").agg(F.count("*").alias("n"), F.sum("filled").alias("filled"))


@query(sql(_DUAL.replace("w AS (SELECT date, instrument, 0.9 *", "w AS (SELECT date, instrument, 1.0 *") + ", q AS (SELECT date, instrument, 'dual_mom' AS mode, weight FROM w UNION ALL SELECT date, instrument, 'equal', 1.0 / count(*) OVER (PARTITION BY date) FROM v UNION ALL SELECT date, instrument, 'inv_vol', inv / nullif(sum(inv) OVER (PARTITION BY date), 0) FROM v), z AS (SELECT date, instrument, mode, CASE WHEN month(date) <> 5 THEN 0.9 * weight ELSE 0.0 END AS weight FROM q)",
    f"SELECT date, instrument, mode, {shown_sql('weight')} FROM z"))
def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to split a sleeve that is closed in May."""
    rows = T.features(panel(spark, sf_dir))
    sleeve, out = F.when(F.month("date") != 5, 0.9).otherwise(0.0), []
    for mode in ("equal", "inv_vol", "dual_mom"):
        out.append(R.quality_targets(rows, ["date"], sleeve, mode, "volatility_20", "momentum_20").select("date", "instrument", F.lit(mode).alias("mode"), shown("weight")))
    return out[0].union(out[1]).union(out[2])


@query("""SELECT kind, multiplier, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'option' WHEN 1 THEN 'warrant' WHEN 2 THEN 'fund' ELSE 'equity' END AS kind, CASE WHEN l_linenumber % 4 = 0 THEN 100 ELSE 1 END AS multiplier FROM lineitem) GROUP BY kind, multiplier""")
def asset_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every class, made of line numbers and keys."""
    key = F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0")
    forms = [F.concat(F.lit("AB980619C0000"), key), F.concat(F.lit("1"), key), F.concat(F.lit("51"), key), F.concat(F.lit("60"), key)]
    code = F.element_at(F.array(*forms), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(K.asset_class(code).alias("kind"))
    return rows.select("kind", K.multiplier(F.col("kind")).alias("multiplier")).groupBy("kind", "multiplier").agg(F.count("*").alias("n"))

