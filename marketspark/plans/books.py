"""Queries on lots, marks, corporate actions, reconciliation and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators import desk as K
from marketspark.operators import records as C
from marketspark.operators.lineage import cut
from marketspark.operators.packing import Keys
from marketspark.plans.desk import _DATED, _dated
from marketspark.plans.factors import shown, shown_sql
from marketspark.plans.inputs import BARS, bars, sql, table
from marketspark.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Line items in a slice of time, within which they are numbered.
_AT_ONCE = 1 << 19
_BY = "PARTITION BY book, symbol"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rest(name: str) -> str:
    return shown_sql(name).rsplit(" AS ", 1)[0]


def _cents(c: str) -> Column:
    return F.round(F.col(c) * (1 + 1e-12), 2).alias(c)


def _cents_sql(x: str, name: str) -> str:
    return f"round(({x}) * (1 + 1e-12), 2) AS {name}"


@query(sql(_DATED, f"SELECT book, symbol, sum(signed) AS holding, {_cents_sql('sum(CAST(-signed * price AS DECIMAL(24, 6)))', 'cash')} FROM costs GROUP BY book, symbol"))
def ledger_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding and cash before fees, exact to the cent: amounts are added as decimals."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    rows = _dated(spark, sf_dir).groupBy("book", "symbol").agg(F.sum(signed).alias("holding"), F.sum((-signed * F.col("price")).cast("decimal(24,6)")).cast("double").alias("cash"))
    return rows.select("book", "symbol", "holding", _cents("cash"))


_LOTS = _DATED + f""", s AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER ({_BY} ORDER BY seq) AS stop, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER ({_BY}) AS sold FROM costs),
lots AS (SELECT book, symbol, date, price, quantity, greatest(least(quantity, stop - sold), 0) AS remaining FROM s WHERE side = 'buy')"""


@query(sql(_LOTS, f"SELECT book, symbol, date, {shown_sql('price')}, quantity, remaining FROM lots WHERE remaining > 0"))
def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every purchase after all sells, oldest first."""
    return C.lots(_dated(spark, sf_dir)).where("remaining > 0").select("book", "symbol", "date", shown("price"), "quantity", "remaining")


@query(sql(_LOTS, "SELECT book, symbol, sum(remaining) AS held, sum(CASE WHEN DATE '1998-08-15' - date >= 30 THEN remaining ELSE 0 END) AS sellable FROM lots GROUP BY book, symbol"))
def lots_sellable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be sold if a purchase must be thirty days old."""
    return C.sellable(C.lots(_dated(spark, sf_dir)), F.lit("1998-08-15").cast("date"), 30)


@query(sql(_DATED, """SELECT book, symbol, bought_at_seq, sold_at_seq, quantity FROM (
  SELECT b.book, b.symbol, b.seq AS bought_at_seq, s.seq AS sold_at_seq, least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity) AS quantity
  FROM (SELECT *, sum(quantity) OVER (PARTITION BY book, symbol, side ORDER BY seq) AS hi FROM costs) b JOIN (SELECT *, sum(quantity) OVER (PARTITION BY book, symbol, side ORDER BY seq) AS hi FROM costs) s
  ON b.book = s.book AND b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.hi - b.quantity < s.hi AND s.hi - s.quantity < b.hi)"""))
def fifo_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice of a sell with the buy that it comes from."""
    lines, orders, customers, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    lines = lines.withColumn("sell", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)))
    # lines are shuffled thrice, for their brand, their order's segment and their number, as two keys and a quantity
    keys = Keys(lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sell"])
    packed = lines.select(*keys.packed(), F.col("l_quantity").alias("quantity"))
    n = -(-keys.rows // _AT_ONCE)
    bounds = packed.agg(F.percentile_approx(F.col(keys.names[0]).cast("double"), F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0] if n > 1 else []
    branded = packed.join(part.select("p_partkey", F.col("p_brand").alias("symbol")), keys.field("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    books = orders.select("o_orderkey", "o_custkey").join(customers.select("c_custkey", F.col("c_mktsegment").alias("book")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "book")
    trades = branded.join(books, keys.field("l_orderkey") == F.col("o_orderkey")).withColumn("sell", keys.field("sell") == 1)
    slices = C.fifo_numbered(trades, keys.names, bounds or [])
    return slices.select("book", "symbol", F.col("bought_at").alias("bought_at_seq"), F.col("sold_at").alias("sold_at_seq"), "quantity")


_HELD = """, held AS (SELECT book, symbol, sum(signed) AS quantity FROM costs GROUP BY book, symbol),
days AS (SELECT symbol, date, arg_max(price, seq) AS close, CASE WHEN count(*) % 3 = 0 THEN 0.0 ELSE sum(quantity) END AS volume FROM costs GROUP BY symbol, date)"""


def _day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last price of each symbol and day; every third day by its number of trades has no volume."""
    volume = F.when(F.count("*") % 3 == 0, 0.0).otherwise(F.sum("quantity")).alias("volume")
    return _dated(spark, sf_dir).groupBy("symbol", "date").agg(F.max_by("price", "at").alias("close"), volume)


@query(sql(_DATED + _HELD + """, m AS (SELECT symbol, arg_max(close, date) AS close, max(date) AS price_date, arg_max(volume, date) AS volume FROM days WHERE date <= DATE '1998-07-01' GROUP BY symbol)""",
    f"SELECT book, h.symbol, quantity, close, price_date, {_rest('(quantity * close)')} AS value, NOT coalesce(price_date = DATE '1998-07-01' AND volume > 0, false) AS stale FROM held h LEFT JOIN m ON h.symbol = m.symbol"))
def positions_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated(spark, sf_dir)
    holdings = K.holdings_at(t, F.lit("2100-01-01").cast("date")).select("book", "symbol", F.col("holding").alias("quantity"))
    return K.marked_positions(holdings, _day_bars(spark, sf_dir), F.lit("1998-07-01").cast("date")).select("book", "symbol", "quantity", "close", "price_date", shown("value"), "stale")


@query(sql(BARS, f"""SELECT instrument, {_rest('close')} AS close FROM (SELECT instrument, coalesce(max_by(close, date) FILTER (date < DATE '1996-03-06'), min_by(close, date) FILTER (date >= DATE '1996-03-06')) AS close
  FROM bars WHERE instrument < 'NATION_2' OR date > DATE '1997-01-01' GROUP BY instrument)"""))
def closes_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the names have no bar before the day; they get their first one after it."""
    b = bars(spark, sf_dir).where("instrument < 'NATION_2' or date > '1997-01-01'")
    return K.close_before(b, F.lit("1996-03-06").cast("date")).select("instrument", shown("close"))


@query(sql(BARS, """SELECT zone, now, count(*) AS bars, max(date) AS last FROM bars, (VALUES ('Asia/Shanghai', TIMESTAMP '1998-06-08 07:04:00', DATE '1998-06-07'), ('Asia/Shanghai', TIMESTAMP '1998-06-08 07:05:00', DATE '1998-06-08'),
  ('America/New_York', TIMESTAMP '1998-06-08 20:04:00', DATE '1998-06-07'), ('America/New_York', TIMESTAMP '1998-06-09 01:00:00', DATE '1998-06-08')) t(zone, now, upto) WHERE date <= upto GROUP BY zone, now"""))
def sessions_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that may be used at four moments in UTC around two closes."""
    b, out = bars(spark, sf_dir), []
    for zone, now, hour in (("Asia/Shanghai", "1998-06-08 07:04:00", 15), ("Asia/Shanghai", "1998-06-08 07:05:00", 15), ("America/New_York", "1998-06-08 20:04:00", 16), ("America/New_York", "1998-06-09 01:00:00", 16)):
        at = F.lit(now).cast("timestamp_ntz")
        out.append(K.closed_sessions(b, at, zone, hour).agg(F.lit(zone).alias("zone"), at.alias("now"), F.count("*").alias("bars"), F.max("date").alias("last")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


_SPLIT = BARS + """, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument ORDER BY date) % 50 = 0 THEN 2.0 ELSE 1.0 END AS split FROM bars),
f AS (SELECT *, coalesce(product(split) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS factor FROM s)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("instrument").orderBy("date"))
    return bars(spark, sf_dir).select("instrument", "date").withColumn("n", nth).where("n % 50 = 0").select("instrument", "date", F.lit(2.0).alias("ratio"))


@query(sql(_SPLIT, f"SELECT instrument, date, {_rest('(close / factor)')} AS close, {_rest('(volume * factor)')} AS volume, {_rest('(close / factor)')} AS adj_close FROM f"))
def split_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth bar of a name is a two-for-one split of nominal bars."""
    return C.from_nominal(bars(spark, sf_dir), _events(spark, sf_dir)).select("instrument", "date", *map(shown, ("close", "volume", "adj_close")))


@query(sql(BARS, f"SELECT instrument, date, {_rest('(open * vwap / close)')} AS open, {_rest('(high * vwap / close)')} AS high, {_rest('vwap')} AS close FROM bars"))
def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vwap read as the adjusted close."""
    return C.adjusted(bars(spark, sf_dir).withColumn("adj_close", F.col("vwap"))).select("instrument", "date", *map(shown, ("open", "high", "close")))


@query(sql(_SPLIT, f"""SELECT a.day, s.instrument, s.date, {_rest('(s.close / s.factor * a.ratio)')} AS close FROM (
  SELECT *, close / (close / factor) AS ratio FROM (SELECT f.*, day, row_number() OVER (PARTITION BY instrument, day ORDER BY date DESC) AS back FROM f, (VALUES (DATE '1996-06-05'), (DATE '1998-06-01')) d(day) WHERE date < day)
  WHERE back = 1) a JOIN f s ON s.instrument = a.instrument AND s.date <= a.date
  QUALIFY row_number() OVER (PARTITION BY a.day, s.instrument ORDER BY s.date DESC) <= 30"""))
def signals_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty split-adjusted bars before two days, in the prices of the session before."""
    raw = bars(spark, sf_dir).select("instrument", "date", "open", "high", "low", "close", "volume")
    signals = C.from_nominal(raw, _events(spark, sf_dir)).select("instrument", "date", "open", "high", "low", "close")
    days = raw.select("instrument").distinct().select("instrument", F.explode(F.array(F.lit("1996-06-05").cast("date"), F.lit("1998-06-01").cast("date"))).alias("day"))
    return C.anchored(signals, raw, days, 30).select("day", "instrument", "date", shown("close"))


@query(sql(_SPLIT + """, n AS (SELECT *, lag(close * factor) OVER (PARTITION BY instrument ORDER BY date) / split - CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN 3.0 ELSE 0.0 END * factor AS reference FROM f)""", """
SELECT instrument, date, 'opening gap' AS reason, 'error' AS severity FROM n WHERE abs(open * factor / nullif(reference, 0) - 1) > 0.35
UNION ALL SELECT instrument, date, 'envelope', 'warning' FROM n WHERE high + 1e-6 < greatest(open, close) OR low - 1e-6 > least(open, close)"""))
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with splits and dividends against the data contract."""
    dividend = F.when(F.col("volume").cast("long") % 5 == 0, 3.0).otherwise(0.0)
    rows = bars(spark, sf_dir).join(_events(spark, sf_dir).withColumnRenamed("ratio", "split"), ["instrument", "date"], "left").withColumn("dividend", dividend)
    return C.contract_issues(rows)


_LEDGER = _DATED.replace("WITH ", "") + """, few AS (SELECT * FROM costs WHERE symbol IN ('Brand#11', 'Brand#23')), closes AS (SELECT symbol, date AS day, arg_max(price, seq) AS close FROM few GROUP BY symbol, date),
flow AS (SELECT book, date AS day, sum(-signed * price - fee) AS flow, sum(fee) AS fees, count(*) AS fills FROM few GROUP BY book, date)"""


@query(sql(_LEDGER, "SELECT book, day, 'cash' AS field, 500.0 AS difference FROM flow WHERE day_of_month_is_first UNION ALL SELECT book, day, 'fills', 1.0 FROM flow WHERE false").replace("day_of_month_is_first", "day >= DATE '1998-06-01'") + " UNION ALL SELECT book, day, 'fees', 2.0 FROM flow WHERE day = DATE '1997-01-10'")
def ledger_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily ledger of two symbols with a wrong cash from June 1998 and wrong fees on one day, against its trades."""
    t = _dated(spark, sf_dir).where("symbol in ('Brand#11', 'Brand#23')").withColumn("day", F.col("date"))
    moves = cut(K.daily_moves(t))  # one row a book, symbol and day; trades are not read again
    flows = moves.groupBy("book", "day").agg(F.sum("flow").alias("flow"), F.sum("fees").alias("fees"), F.sum("fills").alias("fills"))
    w = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("book", "symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    names = moves.select("book", "symbol").distinct()
    held = flows.select("book", "day").join(names, "book").join(moves.select("book", "symbol", "day", "moved"), ["book", "symbol", "day"], "left").withColumn("holding", F.coalesce(F.sum("moved").over(line), F.lit(0.0)))
    stored = held.groupBy("book", "day").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "holding"))).alias("positions"), F.map_from_entries(F.collect_list(F.struct("symbol", F.lit(1000.0)))).alias("closes"), F.sum(F.col("holding") * 1000.0).alias("value"))
    days = flows.join(stored, ["book", "day"]).withColumn("cash", 1e6 + F.sum("flow").over(w)).withColumn("equity", F.col("cash") + F.col("value"))
    days = days.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1e6), F.max("equity").over(w)) - 1)
    wrong = days.withColumns({"cash": F.when(F.col("day") >= F.lit("1998-06-01").cast("date"), F.col("cash") + 500).otherwise(F.col("cash")), "fees": F.when(F.col("day") == F.lit("1997-01-10").cast("date"), F.col("fees") + 2).otherwise(F.col("fees"))})
    found = K.reconciled_moves(wrong.select("book", "day", "cash", "fees", "fills", "positions", "closes", "equity", "drawdown"), moves, F.lit(1e6), 1e-3)
    return found.select("book", "day", "field", F.round(F.col("stored") - F.col("computed"), 3).alias("difference"))


@query(sql(_DATED + """, d AS (SELECT book, date AS day, count(*) AS fills, sum(fee) AS fees, sum(-signed * price - fee) AS flow FROM costs GROUP BY book, date),
c AS (SELECT *, 1e9 + sum(flow) OVER (PARTITION BY book ORDER BY day) AS equity FROM d), e AS (SELECT *, equity / greatest(1e9, max(equity) OVER (PARTITION BY book ORDER BY day)) - 1 AS drawdown FROM c)""",
    f"SELECT book, max(day) AS last_day, {_rest('arg_max(equity, day)')} AS equity, {_rest('(arg_max(equity, day) / 1e9 - 1)')} AS total_return, {_rest('least(0.0, min(drawdown))')} AS max_drawdown, {_rest('sum(fees)')} AS fees, CAST(sum(fills) AS BIGINT) AS fills, CAST(sum(CASE WHEN fills % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stale_days, count(*) AS sessions FROM e GROUP BY book"))
def strategy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.daily_ledger(_dated(spark, sf_dir)).withColumn("equity", 1e9 + F.col("cash"))
    peak = F.max("equity").over(Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    days = d.select("book", F.col("date").alias("day"), "equity", (F.col("equity") / 1e9 - 1).alias("total_return"), (F.col("equity") / F.greatest(F.lit(1e9), peak) - 1).alias("drawdown"), "fees", "fills", (F.col("fills") % 7 == 0).alias("stale"))
    return K.strategy_summary(days).select("book", "last_day", *map(shown, ("equity", "total_return", "max_drawdown", "fees")), "fills", "stale_days", "sessions")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of a book's orders above an amount."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("book"), "o_orderkey", "o_orderdate", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_totalprice") - 100000).alias("over"))
    return K.listing(rows, "F", "at", "over").select("o_orderkey", "o_orderdate", "o_totalprice")


_ENDS = BARS + """, e AS (SELECT instrument, arg_max(close, date) AS price, arg_max(volume, date) AS volume, arg_min(volume, date) AS first FROM bars GROUP BY instrument)"""


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("instrument").agg(F.max_by("close", "date").alias("price"), F.max_by("volume", "date").alias("volume"), F.min_by("volume", "date").alias("first"))


@query(sql(_ENDS + """, h AS (SELECT instrument, price, CAST(first AS BIGINT) AS quantity FROM e WHERE instrument >= 'NATION_15'), t AS (SELECT instrument, price FROM e WHERE instrument < 'NATION_2'),
b AS (SELECT coalesce(t.instrument, h.instrument) AS instrument, coalesce(t.price, h.price) AS price, coalesce(quantity, 0) AS held, t.instrument IS NULL AS leaves, CASE WHEN t.instrument IS NULL THEN 0.0 ELSE 1e7 * 0.98 / 12 END - coalesce(quantity, 0) * coalesce(t.price, h.price) AS amount FROM t FULL JOIN h ON t.instrument = h.instrument),
c AS (SELECT *, least(1.0, 0.4 * 1e7 / sum(abs(amount)) OVER ()) AS scale FROM b), o AS (SELECT instrument, CASE WHEN amount < 0 THEN 'sell' ELSE 'buy' END AS side, CASE WHEN leaves AND scale = 1 THEN held ELSE CAST(floor(abs(amount) * scale / price / 5) * 5 AS BIGINT) END AS quantity FROM c)""",
    "SELECT instrument, side, quantity FROM o WHERE quantity > 0"))
def model_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve targets before NATION_2, first volumes as holdings of the others, at most two fifths turned over."""
    e = _ends(spark, sf_dir)
    holdings = e.where("instrument >= 'NATION_15'").select("instrument", F.col("first").cast("long").alias("quantity"), "price")
    return K.model_orders(e.where("instrument < 'NATION_2'").select("instrument", "price"), holdings, 1e7, 12, 0.4, lot=5)


@query(sql(_ENDS + """, w AS (SELECT instrument, price / sum(price) OVER () AS weight FROM e WHERE instrument < 'NATION_2'), h AS (SELECT instrument, CAST(first AS BIGINT) AS quantity, CAST(floor(first / 2) AS BIGINT) AS sellable FROM e WHERE instrument >= 'NATION_15'),
b AS (SELECT e.instrument, weight, e.price * 1.001 AS unit, coalesce(quantity, 0) AS held, coalesce(sellable, 0) AS sellable FROM (SELECT coalesce(w.instrument, h.instrument) AS instrument, weight, quantity, sellable FROM w FULL JOIN h ON w.instrument = h.instrument) x JOIN e ON e.instrument = x.instrument WHERE CAST(e.volume AS BIGINT) % 4 <> 0),
d AS (SELECT instrument, weight, unit, greatest(coalesce(CAST(floor(5e6 * weight / unit / 5) * 5 AS BIGINT), 0) - held, -sellable) AS delta FROM b),
s AS (SELECT *, sum(CASE WHEN delta > 0 THEN delta * unit ELSE 0 END) OVER (ORDER BY weight DESC NULLS LAST, instrument ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM d WHERE delta <> 0)""",
    "SELECT instrument, delta FROM s WHERE delta < 0 OR spent <= 3e6"))
def book_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by price, half of each holding sellable, quotes with a volume divisible by four are stale."""
    e = _ends(spark, sf_dir)
    members = e.where("instrument < 'NATION_2'")
    weights = members.crossJoin(F.broadcast(members.agg(F.sum("price").alias("all")))).select("instrument", (F.col("price") / F.col("all")).alias("weight"))  # one row
    holdings = e.where("instrument >= 'NATION_15'").select("instrument", F.col("first").cast("long").alias("quantity"), F.floor(F.col("first") / 2).cast("long").alias("sellable"))
    quotes = e.select("instrument", "price", "volume", (F.col("volume").cast("long") % 4 != 0).alias("fresh"))
    return K.share_deltas(weights, holdings, quotes, 5e6, 3e6, lot=5)


@query("SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name FROM part WHERE contains(upper(p_brand || '/' || CAST(p_partkey AS VARCHAR)), '#1') OR contains(upper(p_name), '#1') ORDER BY symbol LIMIT 20")
def instrument_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty hits by symbol or name."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"))
    return K.searched(rows, "#1 ")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days appended whole: a stream of daily rows into one folder a day."""
    folder = feeds.work_folder(spark)
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    daily.repartition(4).write.parquet(f"{folder}/in")
    return feeds.by_day(feeds.source(spark, f"{folder}/in"), f"{folder}/days", "day").select("day", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, CASE WHEN n > 0 THEN total END AS total, CASE WHEN n = 0 THEN 'no answer' END AS error FROM (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS n, round(sum(value) FILTER (event_type = 'click'), 4) AS total FROM events WHERE user_id % 10 <> 3 GROUP BY user_id)""")
def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a request: the sum of their clicks; users whose number ends in 3 are examples and are skipped."""
    folder, events = feeds.work_folder(spark), table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    requests = feeds.source(spark, f"{sf_dir}/events.parquet").select("user_id")
    return feeds.answered(requests, f"{folder}/seen", "user_id", lambda asked: asked.join(clicks, "user_id"), F.col("user_id") % 10 == 3)
