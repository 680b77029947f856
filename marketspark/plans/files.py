"""Queries that write the driver's tables in the forms of market-data files and read them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.plans.factors import shown, shown_sql
from marketspark.plans.inputs import BARS, PANEL, bars, panel, sql, table
from marketspark.plans.market import _show
from marketspark.sources import matrices, stores, tables
from marketspark.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_FIELDS = ("open", "high", "low", "close", "volume")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return feeds.work_folder(spark)


def _rest(name: str) -> str:
    return shown_sql(name).rsplit(" AS ", 1)[0]


@query(sql(BARS, f"SELECT upper(instrument) AS instrument, date, {_rest('close')} AS open, {_rest('close')} AS high, {_show('low', 'close')}, 1.0 AS volume, {_rest('((close + low + close) / 3)')} AS vwap FROM bars"))
def read_csv_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as one folder of CSV for each symbol, with other names and without open, high, volume and vwap."""
    path = _folder(spark)
    rows = bars(spark, sf_dir).select(F.lower("instrument").alias("instrument"), F.col("close").alias("收盘"), F.col("date").alias("trade_date"), F.col("low").alias("Low"))
    rows.write.partitionBy("instrument").option("header", True).csv(path)
    return tables.csv_directory(spark, path, r"instrument=([^/]+)/").select("instrument", "date", *map(shown, (*_FIELDS, "vwap")))


@query(sql(BARS, f"SELECT instrument, date, {_show('open', 'close', 'volume')}, {_rest('((high + low + close) / 3)')} AS vwap FROM bars"))
def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars under other names, as text, without a vwap."""
    rows = bars(spark, sf_dir).select("instrument", F.col("date").cast("string").alias("日期"), *[F.col(c).cast("string").alias(n) for c, n in (("open", "OPEN"), ("high", "最高"), ("low", "low"), ("close", "Close"), ("volume", "VOL"))])
    return tables.bars_from_table(rows).select("instrument", "date", *map(shown, ("open", "close", "volume", "vwap")))


@query(sql(BARS, f"SELECT right('000000' || CAST(100 + CAST(substr(instrument, 8) AS INTEGER) AS VARCHAR), 6) AS instrument, date, {_show('open', 'high', 'low', 'close')}, {_rest('(volume * 100)')} AS volume FROM bars"))
def read_symbols_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars in one CSV under short codes with a suffix, each bar twice: a wrong one before the right one."""
    path = _folder(spark)
    code = F.concat((F.substring("instrument", 8, 2).cast("int") + 100).cast("string"), F.lit(".SZ")).alias("code")
    rows = bars(spark, sf_dir).select(code, "date", *_FIELDS[:4], F.col("volume").alias("vol_hand"), F.explode(F.array(F.lit(0), F.lit(1))).alias("right"))
    rows = rows.withColumn("close", F.when(F.col("right") == 1, F.col("close")).otherwise(-1.0))
    rows.repartition(1).sortWithinPartitions("code", "date", "right").drop("right").write.option("header", True).csv(path)
    return tables.multi_symbol_csv(spark, path).select("instrument", "date", *map(shown, _FIELDS))


@query(sql(BARS, f"SELECT instrument, date, {_rest('close')} AS open, {_rest('close')} AS high, {_show('low', 'close')}, 0.0 AS volume FROM bars"))
def read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).select("instrument", F.concat(F.col("date").cast("string"), F.lit("T09:30:00+08:00")).alias("时间"), F.col("low").alias("最低"), F.col("close").alias("净值"))
    return tables.feed_bars(rows).select("instrument", "date", *map(shown, _FIELDS))


def _moment(hours: int) -> Column:
    """Milliseconds of so many hours after midnight UTC of the date."""
    return (F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 24 + hours) * 3_600_000


_TWICE = sql(BARS, f"SELECT instrument, date, {_show(*_FIELDS)} FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01' AND CAST(volume AS BIGINT) % 11 <> 0")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with some closes missing, each with an earlier wrong one of the same session."""
    missing = F.col("volume").cast("long") % 11 == 0
    return bars(spark, sf_dir).withColumn("close", F.when(~missing, F.col("close"))).withColumn("right", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("open", F.col("open") * F.col("right"))


@query(_TWICE)
def read_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON payload for each name; a session is given by a moment late on its day in New York, early on the next in UTC."""
    cell = F.struct((_moment(26) + F.col("right")).alias("t"), *[F.col(c).alias(k) for k, c in zip("ohlcv", _FIELDS, strict=True)])
    made = _delivered(spark, sf_dir).groupBy("instrument").agg(F.sort_array(F.collect_list(cell)).alias("results"))
    payloads = made.select("instrument", F.to_json(F.struct(F.lit("OK").alias("status"), "results")).alias("payload"))
    return tables.aggregates_json(payloads, "1996-01-01", "1998-01-01").select("instrument", "date", *map(shown, _FIELDS))


@query(_TWICE)
def read_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as parallel arrays."""
    cell = F.struct((_moment(26) / 1000 + F.col("right")).cast("long").alias("t"), *[F.col(c).alias(k) for k, c in zip("ohlcv", _FIELDS, strict=True)])
    made = _delivered(spark, sf_dir).groupBy("instrument").agg(F.sort_array(F.collect_list(cell)).alias("r"))
    payloads = made.select("instrument", F.to_json(F.struct(F.lit("ok").alias("s"), *[F.col("r")[k].alias(k) for k in ("t", *"ohlcv")]), {"ignoreNullFields": "false"}).alias("payload"))
    return tables.candles_json(payloads, "1996-01-01", "1998-01-01").select("instrument", "date", *map(shown, _FIELDS))


@query("SELECT n_name AS instrument, CAST(n_regionkey AS DOUBLE) AS industry FROM nation")
def read_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/map.tsv"
    table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("SW1"), F.concat(F.lit(" "), "n_name").alias("Ticker")).write.option("header", True).csv(path, sep="\t")
    return tables.industry_map(spark, path)


_FLOWS = "SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS net_flow FROM orders GROUP BY 1"


@query(_FLOWS)
def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.round(F.sum("o_totalprice"), 2).alias("Net_Flow"))
    rows.write.option("header", True).csv(path)
    return tables.flows_csv(spark, path)


_MONTHS = "months AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) * 1.0 AS n FROM orders GROUP BY 1, 2)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.trunc(F.to_date("o_orderdate"), "month")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), date.alias("date")).agg(F.count("*").cast("double").alias("n"))


@query(sql(_MONTHS, "SELECT '1-URGENT' AS series_id, date, CASE WHEN month(date) <> 7 THEN n END AS value FROM months WHERE series_id = '1-URGENT'"))
def read_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series as CSV in which Julys are "."."""
    path = _folder(spark)
    value = F.when(F.month("date") == 7, F.lit(".")).otherwise(F.col("n").cast("string"))
    _months(spark, sf_dir).where("series_id = '1-URGENT'").select(F.col("date").alias("observation_date"), value.alias("1-URGENT")).write.option("header", True).csv(path)
    return tables.observations_csv(spark, path, "1-URGENT")


@query(sql(_MONTHS, "SELECT series_id, date, CASE WHEN month(date) <> 7 THEN n END AS value FROM months"))
def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("REPORT_DATE"), F.when(F.month("date") != 7, F.col("n")).alias("BASE"))
    made = _months(spark, sf_dir).groupBy("series_id").agg(F.collect_list(cell).alias("data"))
    payloads = made.select("series_id", F.to_json(F.struct(F.struct("data").alias("result")), {"ignoreNullFields": "false"}).alias("payload"))
    return tables.reports_json(payloads, "BASE")


@query(sql(_MONTHS, "SELECT series_id, CAST(date_trunc('year', date) AS DATE) AS date, sum(n) AS value FROM months GROUP BY 1, 2"))
def read_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _months(spark, sf_dir).groupBy("series_id", F.year("date").cast("string").alias("date")).agg(F.sum("n").alias("value"))
    made = years.groupBy("series_id").agg(F.to_json(F.collect_list(F.struct("date", "value"))).alias("rows"))
    return tables.yearly_json(made.select("series_id", F.concat(F.lit('[{"pages":1},'), "rows", F.lit("]")).alias("payload")))


@query(sql(_MONTHS, """SELECT date, factor, CASE WHEN month(date) <> 7 THEN value END AS value FROM (
  SELECT date, 'Mkt-RF' AS factor, sum(n) FILTER (series_id = '1-URGENT') AS value FROM months GROUP BY date
  UNION ALL SELECT date, 'SMB', sum(n) FILTER (series_id = '2-HIGH') FROM months GROUP BY date)"""))
def read_monthly_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor file: a preface, the header, monthly lines, then a yearly section that must not be read."""
    path = _folder(spark)
    wide = _months(spark, sf_dir).groupBy("date").agg(*[F.sum(F.when(F.col("series_id") == s, F.col("n"))).alias(a) for s, a in (("1-URGENT", "a"), ("2-HIGH", "b"))])
    cells = [F.when(F.month("date") == 7, F.lit("-99.99")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(" -999"))) for c in ("a", "b")]
    line = F.concat_ws(",", F.date_format("date", "yyyyMM"), *cells)
    lines = wide.agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a few hundred months
    text = F.concat(F.lit("made for tests\n\n,Mkt-RF, SMB\n"), F.array_join("lines", "\n"), F.lit("\n\n Annual\n,Mkt-RF,SMB\n1997,1,2\n199801,3,4\n"))
    lines.select(text.alias("value")).coalesce(1).write.text(path)
    return tables.monthly_section(spark, path).select("date", "factor", "value")


@query(sql(PANEL, "SELECT i.instrument, s.first, s.last, s.sessions FROM (SELECT DISTINCT instrument FROM panel) i, (SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS sessions FROM panel) s"))
def layout_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    stores.write_layout(panel(spark, sf_dir).select("date", "instrument", "close"), path)
    days = spark.read.text(f"{path}/calendars").agg(F.count("*").alias("sessions"))
    return stores.read_instruments(spark, path).crossJoin(F.broadcast(days))  # one row


@query(sql(BARS, f"SELECT instrument, date, {_rest('(CASE WHEN instrument = ' + chr(39) + 'NATION_3' + chr(39) + ' THEN close * 2 ELSE close END)')} AS close, instrument = 'NATION_3' AS renewed FROM bars WHERE instrument IN ('NATION_3', 'NATION_4') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'"))
def bar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored by name, one name replaced, then a slice of two names and one field read, with a further field joined."""
    path, b = _folder(spark), bars(spark, sf_dir)
    stores.put_bars(b, path)
    stores.put_bars(b.where("instrument = 'NATION_3'").withColumn("close", F.col("close") * 2), path)
    extra = b.select("instrument", "date", (F.col("instrument") == "NATION_3").alias("renewed"))
    return stores.get_bars(spark, path, ["NATION_3", "NATION_4"], "1996-01-01", "1997-01-01", ["close"], extra).select("instrument", "date", shown("close"), "renewed")


@query("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty records of a trace with broken lines in it."""
    path, e = _folder(spark), table(spark, sf_dir, "events")
    stores.append_trace(e.select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("at")), path)
    e.select(F.lit('{"event_id": 1, "at').alias("value")).write.mode("append").text(path)
    tail = stores.trace_tail(spark, path, "event_id long, at string", "at", 50)
    return tail.select("event_id", F.to_timestamp_ntz(F.substring("at", 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("ts"))


@query("""SELECT form, symbol, count(*) AS n FROM (SELECT l_linenumber AS form, right('000000' || CAST(l_suppkey * 997 % 1000000 AS VARCHAR), 6) AS code FROM lineitem) x,
  LATERAL (SELECT code || CASE WHEN form % 3 = 0 THEN '.SS' WHEN form % 3 = 1 THEN '.SZ' WHEN substr(code, 1, 1) IN ('5', '6', '9') THEN '.SS' ELSE '.SZ' END AS symbol) y GROUP BY form, symbol""")
def symbol_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys written as codes in three ways, brought to one."""
    code = (F.col("l_suppkey") * 997 % 1_000_000).cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), code, F.lit(".sh"))).when(F.col("l_linenumber") % 3 == 1, F.concat(code, F.lit(".Sz"))).otherwise(code)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("form"), tables.canonical_symbol(raw).alias("symbol"))
    return rows.groupBy("form", "symbol").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT right('000000' || CAST(o_custkey AS VARCHAR), 6) AS code FROM orders WHERE o_custkey <> 300")
def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("SH"), F.col("o_custkey").cast("string")).alias("code"))
    return tables.constituents(rows)


@query(sql(BARS, "SELECT max(date) AS last, CAST(DATE '1998-12-31' - max(date) AS INTEGER) AS age, DATE '1998-12-31' - max(date) BETWEEN 0 AND 7 AS fresh FROM bars"))
def snapshot_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.freshness(bars(spark, sf_dir), F.lit("1998-12-31").cast("date"))


@query(sql(BARS, "SELECT instrument, count(*) AS stored_rows, CASE WHEN instrument <> 'NATION_5' THEN count(*) ELSE 0 END AS rows FROM bars WHERE instrument IN ('NATION_3', 'NATION_5') GROUP BY instrument"))
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest tells of a delivery in which one name changed by a cent and one is gone."""
    b = bars(spark, sf_dir)
    now = b.where("instrument <> 'NATION_5'").withColumn("close", F.when((F.col("instrument") == "NATION_3") & (F.col("date") == F.lit("1997-01-06").cast("date")), F.col("close") + 0.01).otherwise(F.col("close")))
    return stores.changed(stores.manifest(b), stores.manifest(now)).withColumn("rows", F.coalesce("rows", F.lit(0)))


@query(sql(BARS, f"SELECT date, instrument, {_show('close', 'volume')}, {_rest('CASE WHEN date >= DATE ' + chr(39) + '1997-01-01' + chr(39) + ' THEN high - low END')} AS spread FROM bars WHERE instrument < 'NATION_2' AND date >= DATE '1996-01-01'"))
def read_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as another tool's matrix: features under one name, labels beside them, a feature that only later files have;
    read for the names and dates of a smaller panel."""
    path = _folder(spark)
    b = bars(spark, sf_dir).withColumns({"datetime": F.col("date").cast("timestamp"), "label": F.struct(F.col("close").alias("LABEL0")), "LABEL1": F.col("open")})
    for name, part, more in (("early", b.where("date < '1997-01-01'"), []), ("late", b.where("date >= '1997-01-01'"), [(F.col("high") - F.col("low")).alias("spread")])):
        part.select("datetime", "instrument", F.struct("close", "volume", *more).alias("feature"), "label", "LABEL1").write.parquet(f"{path}/part={name}")
    small = b.where("instrument < 'NATION_2' and date >= '1996-01-01'")
    return matrices.read_matrix(spark, f"{path}/*", small).select("date", "instrument", *map(shown, ("close", "volume", "spread")))
